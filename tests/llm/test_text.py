import numpy as np
import pyarrow as pa

from terrarank.llm import text
from terrarank.llm.text import CHUNK, MARKS, Words, as_bytes, shingles, slices

TEXTS = ["The cat\tsat on the MAT", None, "", "   ", "one two", "héé 日本 x\n\ny", "a" * 3000 + " b"]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])


def test_words_agree_with_split():
    for limit in (1, 40, 1 << 20):
        seen: dict[bytes, int] = {}
        rows = 0
        for piece in slices(batch(TEXTS), limit=limit):
            w = Words(*as_bytes(piece.column("text")))
            for k, text in enumerate(piece.column("text").to_pylist()):
                want = [x.encode().lower() for x in (text or "").split()]
                own = w.hash[w.first[k]: w.first[k + 1]].tolist()
                assert len(own) == len(want)
                assert all(seen.setdefault(x, h) == h for x, h in zip(want, own))
            rows += piece.num_rows
        assert rows == len(TEXTS) and len(set(seen.values())) == len(seen)


def test_words_without_marks():
    w = Words(*as_bytes(pa.array(["idiot### x", "(Idiot)!"])), MARKS)
    assert w.count.tolist() == [2, 1] and w.hash[0] == w.hash[2]


def test_shingles_count_and_stay_inside_texts():
    tokens, row = shingles(Words(*as_bytes(pa.array(["a b c d e f", "a b c d e", "a b", "", "b a", "a b c d e f"]))))
    assert np.bincount(row, minlength=6).tolist() == [2, 1, 1, 0, 1, 2]
    of = [tokens[row == k].tolist() for k in range(6)]
    assert of[0] == of[5] and of[1][0] == of[0][0] and of[2] != of[4]


def test_what_a_worker_held_goes_before_it_keeps_more(monkeypatch):
    given = []
    pool = pa.default_memory_pool()
    monkeypatch.setattr(text, "_KEPT", {"other": 1})
    monkeypatch.setattr(text.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: (pool.release_unused(), given.append(1))})())
    text._POWERS.clear()
    Words(*as_bytes(pa.array(["a b c"])))
    assert len(text._POWERS[0]) < 1.25 * CHUNK
    assert text.kept("own", lambda: (len(text._KEPT), len(text._POWERS), len(given))) == (0, 0, 1)
    assert text.kept("own", lambda: 2) == (0, 0, 1) and len(given) == 2
    text.forget()
    assert not text._KEPT and len(given) == 3
    Words(*as_bytes(pa.array(["a" * 2 * CHUNK + " b"])))
    assert len(text._POWERS[0]) >= 2 * CHUNK
    text._POWERS.clear()
