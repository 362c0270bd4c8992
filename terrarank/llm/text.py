"""Whole columns of text as numpy arrays: words, hashes and shingles of an Arrow batch in a few passes.

A word is a run of bytes other than space and tab to carriage return, with A-Z lowered. Null text is empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

T = TypeVar("T")
CHUNK = 1 << 20  # bytes of text worked on at once; a longer document is a chunk of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

MARKS = np.ones(256, dtype=bool)  # all but letters, digits and bytes of other scripts
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_STEP, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that any bits of the result can serve as a hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers, the same in every task."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], T]) -> T:
    """A table of this worker process that outlives its tasks, until one of another operator asks for its own or forgets all.

    Before it is made, all else that this process holds goes, and so do in each task Arrow's pages of batches that are gone.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Give back what earlier tasks of this worker process have kept, and Arrow's pages of batches that are gone."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK) * 9 // 8   # a chunk ends after the text that fills it
        both = []
        for base in (_STEP, _BACK):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, whatever the row count: memory does not follow long texts."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row starts and ends."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


class Words:
    """The words of a chunk: ``start``, ``end`` (byte positions), ``doc`` (row) and ``hash``. ``outside``: bytes between words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> None:
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        n = len(data)
        self.low = LOWER[data]
        inside = ~outside[data]
        full = offsets[1:] > offsets[:-1]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = offsets[:-1][full]
        begins[first] = inside[first]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = offsets[1:][full] - 1
        ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets[1:], self.start, side="right")
        self.count = np.bincount(self.doc, minlength=self.rows)
        self.first = np.concatenate(([0], np.cumsum(self.count)))  # first word of each row
        if len(self.start):
            up, down = _powers(n)
            # bytes between words add nothing
            sums = np.add.reduceat(np.where(outside, 0, _BYTE)[self.low] * up[:n], self.start)
            self.hash = mix(sums * down[self.start])
        else:
            self.hash = np.zeros(0, np.uint64)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words and their rows, in order. A shorter text is one shingle; an empty one has none."""
    h, doc, n = words.hash, words.doc, len(words.hash)
    by = seeds(width, 5)
    if n >= width:
        total = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            total += mix(h[j: n - width + 1 + j] ^ by[j]) * by[j]
        whole = doc[: n - width + 1] == doc[width - 1:]
        out, rows = mix(total[whole]), doc[: n - width + 1][whole]
    else:
        out, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for j in range(width):
            has = words.count[short] > j
            own[has] += mix(h[words.first[short[has]] + j] ^ by[j]) * by[j]
        out, rows = np.concatenate((out, mix(own ^ np.uint64(width)))), np.concatenate((rows, short))
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until none is a column of the table."""
    taken = {c.lower() for c in docs.columns}
    more = next(m for m in ("_" * i for i in range(len(taken) + 1)) if not taken & {n.lower() + m for n in names})
    return [n + more for n in names]
