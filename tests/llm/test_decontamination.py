import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from terrarank.llm import decontamination as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1) if w else ():
            for i in range(len(own) - k + 1):
                if own[i:i + k] == w[a:a + k]:
                    hit |= set(range(i, i + k))
                    found.add("" if item is None else str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def made(seed, letters, items, docs):
    """Texts over few words, so that windows overlap and share endings."""
    random.seed(seed)
    text = lambda n: " ".join(random.choice(letters) for _ in range(n))
    tests = [(i, text(random.choice([0, 1, 2, 3, 4, 6, 9, 15]))) for i in range(items)]
    rows = []
    for i in range(docs):
        parts = [text(random.randint(0, 12))] + [random.choice(tests)[1] for _ in range(random.randint(0, 2))] + [text(random.randint(0, 6))]
        rows.append((i, random.choice([" ", "  ", ", ", "\n"]).join(parts), "a"))
    return tests, rows


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id long, text string, spans string, class int")


@pytest.mark.parametrize("window,shard,letters", [(4, 1 << 20, "abc"), (4, 40, "abcd"), (10, 1 << 20, "ab"), (2, 25, "abcdefgh")])
def test_against_brute_force(spark, documents, window, shard, letters):
    items, rows = made(window + shard, letters, 30, 60)
    got = d.decisions(documents(rows), benchmark(spark, items), d.Settings(window=window, shard_words=shard)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(rows[r.doc_id][1], items, window), rows[r.doc_id]


def test_edges(spark, documents):
    ten = "One two THREE four five six seven eight nine ten"
    items = [(10, ten), (9, "one, two; three four five six seven eight nine ten eleven"), (9, "another text of item nine"), (None, "short item"), (3, None), (4, ""), (5, "..."),
             (11, "Ünïcode wörds ärè whölé"), (12, ten)]
    rows = [(1, ten.upper(), "a"), (2, "x " + ten.replace(" ", "--") + " eleven y", "a"), (3, None, "a"), (4, "", "a"), (5, "one two three four five six seven eight nine", "a"),
            (6, "a Short-item and another text of item nine", "a"), (None, "short item", "a"), (None, "short item", "a"), (6, "clean", "a"),
            (7, "Ünïcode WöRDS ärè WHölé", "a"), (8, "ÜNÏCODE WÖRDS ÄRÈ WHÖLÉ", "a"), (9, "pad " * 200_000 + ten + " pad" * 10, "a"), (10, "shortitem", "a")]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.decisions(documents(rows), benchmark(spark, items)).collect()), key=str)
    assert got == sorted(((i, *brute(t, items, 10)) for i, t, _ in rows), key=str)
    assert {g[0] for g in got if g[-1]} == {1, 2, 6, None, 7, 9}


def test_long_items_are_cut_without_losing_windows(spark, documents):
    random.seed(5)
    long = [f"w{random.randrange(50)}" for _ in range(400)]
    rows = [(i, " ".join(long[i: i + 12]), "a") for i in range(0, 380, 7)]
    got = d.decisions(documents(rows), benchmark(spark, [(1, " ".join(long))]), d.Settings(shard_words=160)).collect()
    assert all(r.n_hit == 12 and r.n_items == 1 for r in got) and len(got) == len(rows)


def test_empty_tables(spark, documents):
    docs, none = documents([(1, "some words", "a")]), benchmark(spark, [])
    assert [tuple(r)[:4] for r in d.decisions(docs, none).collect()] == [(1, 2, 0, 0)]
    assert d.decisions(docs.limit(0), benchmark(spark, [(1, "some words")])).count() == 0
    assert [r.text for r in d.cleaned(docs, none).collect()] == ["some words"]


def test_cleaned(spark, documents):
    ten, pad = "one two three four five six seven eight nine ten", "other words that are not in any item at all and go on and on"
    rows = [(1, f"{pad}, {ten}! {pad}", "a"), (2, ten, "a"), (3, f"ä {pad} {ten} ö", "a"), (4, None, "a"), (5, f"{pad} two items {pad}", "a")]
    docs = documents(rows).withColumn("row", F.lit(1)).withColumn("spans", F.lit("s"))
    out = d.cleaned(docs, benchmark(spark, [(1, ten), (2, "two items")]))
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"{pad}, ! {pad}", 3: f"ä {pad}  ö", 4: None, 5: f"{pad} two items {pad}"}


def test_automaton_knows_every_ending():
    items = [(0, [b"a", b"b", b"a", b"b", b"c"]), (1, [b"a", b"b", b"c", b"a"]), (2, [b"b", b"c"]), (3, [b"a", b"b", b"a", b"b", b"c"])]
    own = d.Automaton()
    for _, item in items:
        own.add([w[0] for w in item])
    for _, item in items:
        for i in range(len(item)):
            for j in range(i + 1, len(item) + 1):
                at = 0
                for w in item[i:j]:
                    at = own.next[at][w[0]]
                assert own.length[own.link[at]] < j - i <= own.length[at]
    assert len(own.length) <= 2 * sum(len(i) for _, i in items)
