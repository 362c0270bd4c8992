import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from terrarank.llm import alignment

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def text_bytes_a(a, ids):
    letters = alignment.byte_letters()
    return [bytes(letters[c] for c in a.id_to_token(i)) for i in ids]


def text_bytes_b(b, ids):
    return [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids)]


def brute(libraries, text):
    """Groups and links of one text, a token at a time."""
    a, b = libraries
    if not text:
        return None
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ba, bb = text_bytes_a(a, ia), text_bytes_b(b, ib)
    if b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
        return None
    groups, links, x, y, ga, gb, ea, eb = [], [], 0, 0, [], [], 0, 0
    while x < len(ia) or y < len(ib):
        if ea <= eb and x < len(ia):
            ga.append(ia[x])
            ea += len(ba[x])
            x += 1
        else:
            gb.append(ib[y])
            eb += len(bb[y])
            y += 1
        if ea == eb:
            groups.append((ga, gb))
            links.append((ga[-1], gb[-1]))
            ga, gb = [], []
    return ia, ib, groups, links


TEXTS = ["Hello world", None, "", " ", "   two  spaces ", "<|endoftext|> and <s> </s> <unk> <0x41>", "Zürich, ünïcode and 漢字 and emoji 🙂🙂", "tab\tline\n\n  end", "▁ underline", "Hello world", "\u0000 nul",
         "don't we'll I'm", "1234567890 3.14", "ﬁ ligature ½", "x" * 3000, "word " * 15_000, "é" * 70_000, "לשלום مرحبا", "a b　c", "\r\n"]


def noise(seed, n):
    random.seed(seed)
    letters = "abcdefgh  ,.'\n\té漢🙂0123ABC<|>▁ſß¼"
    return ["".join(random.choice(letters) for _ in range(random.randint(1, 60))) for _ in range(n)]


def test_against_brute_force(spark, documents, libraries):
    texts = TEXTS + noise(1, 150)
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(None, "Hello world", "b"), (3, "again", "b")]
    got = alignment.summary(documents(rows).repartition(3), A, public.PATTERN, B).collect()
    want = [brute(libraries, t) for _, t, _ in rows]
    count = Counter(link for w in want if w for link in w[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    expected = []
    for (i, _, _), w in zip(rows, want):
        if w is None:
            expected.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        ia, ib, groups, links = w
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        expected.append((i, len(ia), len(ib), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                         hashlib.sha256(written.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert sum(w is None for w in want) >= 3


def test_groups(spark, documents, libraries):
    rows = [(i, t, "a") for i, t in enumerate(TEXTS[:10])]
    for r in alignment.groups(documents(rows), A, public.PATTERN, B).collect():
        w = brute(libraries, rows[r.doc_id][1])
        assert [(list(g.a), list(g.b)) for g in r.groups] == (w[2] if w else [])


def test_common_ends():
    rng = np.random.default_rng(3)
    for _ in range(200):
        total = int(rng.integers(1, 200))
        a, b = (np.unique(np.concatenate((rng.integers(1, total + 1, 40), [total]))) for _ in range(2))
        i, j = alignment.common_ends(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_plain_texts_have_the_librarys_ids(libraries):
    """The faster path is only taken where both libraries agree on what a letter, a digit and white space are."""
    own = alignment.ByteLevel(A, public.PATTERN)
    letters = [chr(c) for c in range(ord(alignment.PLAIN)) if not 0xD800 <= c < 0xE000]
    texts = [t for c in letters for t in (f"a{c}b", f" {c}{c} {c}1", f"{c}  {c}")] + noise(2, 300)
    assert own.encode(texts) == [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]


def test_pairs_are_all_that_can_end_together():
    a, b = [b"x", b"ax", b"", b"yax"], [b"ax", b"x", b"x", b"zyax", b"q"]
    own = alignment.Pairs(a, b)
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x)))
    assert [(int(k) // 5, int(k) % 5) for k in own.key] == want
    i, j = map(np.array, zip(*want))
    assert own.number(i, j).tolist() == list(range(len(want)))


def test_empty_table(spark, documents):
    docs = documents([(1, "x", "a")]).limit(0)
    assert alignment.summary(docs, A, public.PATTERN, B).count() == 0
    assert alignment.groups(docs, A, public.PATTERN, B).count() == 0
