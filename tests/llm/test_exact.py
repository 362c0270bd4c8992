import random

import pytest

from terrarank.llm import exact
from terrarank.llm.exact import Trie


def brute(rows):
    groups: dict[str, list] = {}
    for d, t, _ in rows:
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(d)
    return groups


ROWS = [(1, "Same Text", "a"), (2, "same text", "a"), (3, "SAME TEXT", None), (4, "other", "b"), (5, None, "b"), (6, "", "b"), (None, "other", "b"),
        (7, "É", "a"), (8, "é", "a"), (9, "long " * 40_000, "a"), (10, "LONG " * 40_000, "a"), (11, "same text ", "a"), (None, None, "c")]


def test_decisions_against_brute_force(spark, documents):
    rows = exact.decisions(documents(ROWS)).collect()
    groups = brute(ROWS)
    assert len(rows) == len(ROWS)
    want = {}
    for ids in groups.values():
        best = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want.setdefault((i, best, len(ids), i == best), 0)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows} == set(want)
    assert exact.decisions(documents(ROWS).limit(0)).count() == 0


def test_without_copies_keeps_one_row_each_with_its_columns(spark, documents):
    docs = documents(ROWS + [(4, "other", "b"), (10, "LONG " * 40_000, "a")])
    stays = exact.without_copies(docs)
    assert stays.columns == docs.columns
    rows = stays.collect()
    assert sorted(r.doc_id for r in rows) == [3, 4, 6, 7, 8, 10, 11]


def test_smallest_owner(spark, documents):
    rows = exact.decisions(documents(ROWS), largest=False).where("group_size = 3").collect()
    assert {r.keep_id for r in rows} == {1, 5}


@pytest.mark.parametrize("limit", [1 << 30, 3000, 0])
def test_trie_and_its_spills(limit):
    random.seed(limit)
    words = [bytes(random.choice(b"ab") for _ in range(random.randint(0, 12))) for _ in range(400)] + [b"x" * 5000 + bytes([i]) for i in range(40)] + [b""]
    trie, want = Trie(max, limit), {}
    for i in range(3000):
        w = random.choice(words)
        trie.insert(w, i)
        best, n = want.get(w, (0, 0))
        want[w] = (max(best, i), n + 1)
    assert {t: (o.best, o.rows) for t, o in trie.owners()} == want
