"""Operator 12, benchmark decontamination: a generalised suffix automaton of normalised test items.

Words are runs of digits, letters and bytes of other scripts with A-Z lowered; an item is its sequence of words. All items
are entered, each from the root, into one automaton over words: every state is a set of word sequences that end at the same
places of the items, and the link of a state leads to the longest of their endings that occurs at more places. Training text
streams through it: a word either extends the longest match so far or shortens it along the links until it fits. A place whose
match has at least ``window`` words ends an occurrence of a window (``window`` consecutive words of an item); the state of
those last words knows the items. An item of fewer words is one window, marked at the state of the whole item, and found by
following marks along the links. Words that no item has, and neighbours that no item has side by side, end every match, so
they are looked up by hash for a whole block of text at once, and only the runs between them (compared by their letters, not
hashes) go through the automaton, if they are as long as the shortest window.

Distinct items are dealt out to shards of about ``shard_words`` words, each built by one task; a longer item is cut into
overlapping parts that keep every window. Documents go through one shard after another, carrying the spans so far, so what is
broadcast at a time follows ``shard_words``, never the size of the benchmark.

``marked`` gives the spans, ``decisions`` counts and a verdict per document, ``cleaned`` removes the spans that are longer than
``most_words`` words, and whole documents of which more than ``most_share`` of the words are hit.

Edges: null text has no words; a text or item without words has no windows; rows of the benchmark that share an item_id are one
item, a null item_id is the item with the empty name; a very long text is streamed in one block of its own; repeated rows get
their rows each; an empty benchmark hits nothing, an empty table gives an empty result; other columns are ignored, or pass in
``cleaned`` whatever their names.
"""

from __future__ import annotations

import math
import pickle
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_checked, durable
from .text import MARKS, Words, as_bytes, forget, kept, slices

SPANS = "array<struct<a: int, b: int>>"


@dataclass(frozen=True)
class Settings:
    window: int = 10
    shard_words: int = 1 << 20
    most_words: int = 9        # ``cleaned``: longer spans go
    most_share: float = 0.5    # ``cleaned``: documents hit in more than this part go


class Automaton:
    """Suffix automaton of several sequences of word numbers; ``length`` and ``link`` per state, ``moves`` from (state, word)."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, before: int, word: int, long: int) -> int:
        """The sequences of ``long`` that are no longer than a move from ``before`` get a state of their own."""
        own = self._state(self.length[before] + 1, self.link[long], dict(self.next[long]))
        self.link[long] = own
        while before >= 0 and self.next[before].get(word) == long:
            self.next[before][word] = own
            before = self.link[before]
        return own

    def add(self, words: list[int]) -> None:
        at = 0
        for word in words:
            there = self.next[at].get(word)
            if there is not None:   # another item begins alike
                at = there if self.length[there] == self.length[at] + 1 else self._split(at, word, there)
                continue
            new = self._state(self.length[at] + 1, 0, {})
            p = at
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                there = self.next[p][word]
                self.link[new] = there if self.length[there] == self.length[p] + 1 else self._split(p, word, there)
            at = new


@dataclass(frozen=True)
class Shard:
    """An automaton in arrays that travel: moves sorted by state * words + word, and per state what matches there mean.

    ``anchor``: the state of a match's last ``window`` words. ``whole``: the nearest state along the links, itself included, at
    which a short item is marked. ``held`` and ``held_at``: classes of items per anchor; ``marks``: (words, classes) per marked state.
    """

    words: list[bytes]
    window: int
    shortest: int
    moves: np.ndarray
    target: np.ndarray
    length: np.ndarray
    link: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray
    held_at: np.ndarray
    held: np.ndarray
    marks: dict[int, list[tuple[int, list[int]]]]
    pairs: np.ndarray
    hashes: np.ndarray
    by_hash: np.ndarray


def build(items: list[tuple[int, list[bytes]]], window: int) -> Shard:
    """A shard of (class, words) items."""
    words = sorted({w for _, item in items for w in item})
    number = {w: i for i, w in enumerate(words)}
    coded = [(c, [number[w] for w in item]) for c, item in items if item]
    own = Automaton()
    for _, item in coded:
        own.add(item)
    length, link = np.array(own.length, np.int32), np.array(own.link, np.int32)
    order = np.argsort(length, kind="stable")
    anchor, whole = np.zeros(len(length), np.int32), np.full(len(length), -1, np.int32)
    marks: dict[int, list[tuple[int, list[int]]]] = {}
    windows: set[tuple[int, int]] = set()
    for s in order[1:].tolist():   # links lead to shorter states
        anchor[s] = anchor[link[s]] if length[link[s]] >= window else s
    for c, item in coded:
        at = 0
        for i, word in enumerate(item):
            at = own.next[at][word]
            if i + 1 >= window:
                windows.add((int(anchor[at]), c))
        if len(item) < window:
            marks.setdefault(at, []).append((len(item), [c]))
    for s in order[1:].tolist():
        whole[s] = s if s in marks else whole[link[s]]
    moves = np.array([s * len(words) + w for s, m in enumerate(own.next) for w in m], np.int64)
    target = np.array([t for m in own.next for t in m.values()], np.int32)
    by = np.argsort(moves)
    at_class = np.array(sorted(windows), np.int64).reshape(-1, 2)
    joined = " ".join(w.decode() for w in words)
    hashes = Words(*as_bytes(pa.array([joined])), MARKS).hash
    by_hash = np.argsort(hashes, kind="stable")
    pairs = np.unique(np.array([x * len(words) + y for _, item in coded for x, y in zip(item, item[1:])], np.int64))
    return Shard(words, window, min((min(len(i), window) for _, i in coded), default=0), moves[by], target[by], length, link, anchor, whole,
                 np.searchsorted(at_class[:, 0], np.arange(len(length) + 1)), at_class[:, 1], marks, pairs, hashes[by_hash], by_hash)


class Stream:
    """A shard ready to read text."""

    def __init__(self, shard: Shard) -> None:
        self.shard, self.width = shard, len(shard.words)
        self.moves, self.target = array("q", shard.moves.tobytes()), array("i", shard.target.tobytes())
        self.length, self.link = array("i", shard.length.tobytes()), array("i", shard.link.tobytes())
        self.anchor, self.whole = array("i", shard.anchor.tobytes()), array("i", shard.whole.tobytes())

    def _numbers(self, w: Words) -> np.ndarray:
        """The number of each word whose hash an item's word has, else -1."""
        at = np.minimum(np.searchsorted(self.shard.hashes, w.hash), max(0, self.width - 1))
        return np.where(self.shard.hashes[at] == w.hash, self.shard.by_hash[at], -1)

    def _runs(self, w: Words, number: np.ndarray) -> tuple[list[int], list[int]]:
        """First and last word of each run of words of one text that stand side by side in some item."""
        n, pairs = len(number), self.shard.pairs
        joined = np.zeros(max(0, n - 1), bool)
        near = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0) & (w.doc[:-1] == w.doc[1:]))
        if len(pairs):
            key = number[near].astype(np.int64) * self.width + number[near + 1]
            joined[near] = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key
        known = number >= 0
        first = known & ~np.concatenate(([False], joined))
        last = known & ~np.concatenate((joined, [False]))
        return np.flatnonzero(first).tolist(), np.flatnonzero(last).tolist()

    def read(self, w: Words) -> tuple[list[tuple[int, int]], list[int], dict[int, set[int]]]:
        """Occurrences of windows as (first, last) word; the longest match, and classes of items found, by row of the block."""
        s, found, classes, longest = self.shard, [], {}, [0] * w.rows
        if not len(w.hash) or not s.words:
            return found, longest, classes
        number, moves, width, length, link = self._numbers(w), self.moves, self.width, self.length, self.link
        text, end_of = w.low.tobytes(), len(moves)
        for a, b in zip(*self._runs(w, number)):
            if b - a + 1 < s.shortest:
                continue
            state = matched = 0
            row, own = int(w.doc[a]), None
            for i, (x, begin, end) in enumerate(zip(number[a: b + 1].tolist(), w.start[a: b + 1].tolist(), w.end[a: b + 1].tolist()), a):
                if text[begin:end] != s.words[x]:
                    state = matched = 0
                    continue
                while True:
                    k = bisect_left(moves, state * width + x)
                    if k < end_of and moves[k] == state * width + x:
                        state, matched = self.target[k], matched + 1
                        break
                    if not state:
                        matched = 0
                        break
                    state = link[state]
                    matched = length[state]
                if matched < s.shortest:
                    continue
                if matched > longest[row]:
                    longest[row] = matched
                if matched >= s.window:
                    own = own if own is not None else classes.setdefault(row, set())
                    at = self.anchor[state]
                    own.update(s.held[s.held_at[at]: s.held_at[at + 1]].tolist())
                    found.append((i - s.window + 1, i))
                at = self.whole[state]
                while at >= 0:
                    for size, marked in s.marks[at]:
                        if size <= matched:
                            own = own if own is not None else classes.setdefault(row, set())
                            own.update(marked)
                            found.append((i - size + 1, i))
                    at = self.whole[link[at]]
        return found, longest, classes


def _parts(benchmark: DataFrame, s: Settings) -> DataFrame:
    """name and words (joined by spaces) of every item or part of one that has words."""
    most = max(s.shard_words // 8, 2 * s.window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch):
                w = Words(*as_bytes(piece.column("text")), MARKS)
                text, names, parts, sizes = w.low.tobytes(), [], [], []
                for row, name in enumerate(piece.column("name").to_pylist()):
                    first, last = int(w.first[row]), int(w.first[row + 1])
                    for a in range(first, last, most):
                        b = min(a + most + s.window - 1, last)
                        if a > first and b - a < s.window:
                            break   # the part before has these words
                        names.append(name)
                        parts.append(b" ".join(text[x:y] for x, y in zip(w.start[a:b], w.end[a:b])).decode())
                        sizes.append(b - a)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string()), pa.array(sizes, pa.int64())], names=["name", "words", "size"])

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").mapInArrow(run, "name string, words string, size long")


def shards(benchmark: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(shard, data) of the automata, and (class, name) of the items they know."""
    parts = durable(_parts(benchmark, s).distinct())
    classes = durable(parts.groupBy("words").agg(F.first("size").alias("size")).withColumn("class", F.monotonically_increasing_id()))
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    count = math.ceil(total / s.shard_words)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[tuple[int, list[bytes]]] = []
        key = None
        out = lambda: pa.RecordBatch.from_pydict({"shard": pa.array([key], pa.int32()), "data": pa.array([pickle.dumps(build(held, s.window))], pa.binary())})
        for batch in batches:
            for shard, c, words in zip(*(batch.column(x).to_pylist() for x in ("shard", "class", "words"))):
                if held and shard != key:
                    yield out()
                    held = []
                key = shard
                held.append((c, words.encode().split(b" ")))
        if held:
            yield out()

    dealt = classes.select(F.pmod(F.xxhash64("words"), F.lit(max(1, count))).cast("int").alias("shard"), "class", "words")
    made = durable(dealt.repartition("shard").sortWithinPartitions("shard", "class").mapInArrow(make, "shard int, data binary"))
    return made, durable(parts.join(classes.select("words", "class"), "words").select("class", "name").distinct())


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _through(rows: DataFrame, data: bytes) -> DataFrame:
    """One shard's matches added to (row, text, n_words, spans, classes, longest)."""
    sent = rows.sparkSession.sparkContext.broadcast(data)
    key = uuid.uuid4().hex
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = kept(key, lambda: Stream(pickle.loads(sent.value)))
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            for piece in slices(batch):
                w = Words(*as_bytes(piece.column("text")), MARKS)
                found, longest, classes = stream.read(w)
                spans, ids = piece.column("spans").to_pylist(), piece.column("classes").to_pylist()
                hits: dict[int, list[tuple[int, int]]] = {}
                for a, b in found:
                    row = int(w.doc[a])
                    hits.setdefault(row, []).append((a - int(w.first[row]), b + 1 - int(w.first[row])))
                for row, new in hits.items():
                    spans[row] = [{"a": a, "b": b} for a, b in _union([*((x["a"], x["b"]) for x in spans[row]), *new])]
                    ids[row] = sorted({*ids[row], *classes[row]})
                longest = np.maximum(piece.column("longest").to_numpy(), longest)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row"), piece.column("text"), pa.array(w.count.astype(np.int64)), pa.array(spans, kind), pa.array(ids, pa.list_(pa.int64())), pa.array(longest, pa.int32())],
                    names=["row", "text", "n_words", "spans", "classes", "longest"])

    return rows.mapInArrow(run, schema)


def _counted(rows: DataFrame) -> DataFrame:
    """Words alone, for a benchmark without items."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                n = pa.array(Words(*as_bytes(piece.column("text")), MARKS).count.astype(np.int64))
                yield pa.RecordBatch.from_arrays([n if f == "n_words" else piece.column(f) for f in piece.schema.names], names=piece.schema.names)

    return rows.mapInArrow(run, schema)


def marked(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A row per document, and (class, name) of the items.

    ``row``: the doc_id, or all columns as a struct; ``spans``: words from ``a`` up to ``b`` that windows cover, apart from each other; ``classes``: the
    items found; ``longest``: words of the longest match, if it is as long as the shortest window.
    """
    made, names = shards(benchmark, s)
    rows = docs.select((F.struct(*docs.columns) if row == "*" else F.col("doc_id").cast("long")).alias("row"), F.col("text").cast("string").alias("text"),
                       F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<long>").alias("classes"), F.lit(0).alias("longest"))
    numbers = [r[0] for r in made.select("shard").orderBy("shard").collect()]
    for k, number in enumerate(numbers):
        rows = _through(rows if k == 0 else durable(rows), bytes(made.where(F.col("shard") == number).first()["data"]))
    return (rows if numbers else _counted(rows)), names


def decisions(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest and spans of every document."""
    rows, names = marked(docs, benchmark, s)
    rows = durable(rows.drop("text"))
    # documents that found the same items share one list of names
    lists = rows.where(F.size("classes") > 0).select("classes").distinct()
    items = (lists.select("classes", F.explode("classes").alias("class")).join(broadcast_checked(names), "class")
             .groupBy("classes").agg(F.array_sort(F.collect_set("name")).alias("names"))
             .select("classes", F.size("names").cast("long").alias("n"), F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("sha")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return rows.join(broadcast_checked(durable(items)), "classes", "left").select(
        F.col("row").alias("doc_id"), "n_words", hit.alias("n_hit"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"), "longest", "spans")


def cleaned(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """All columns of the documents that stay, their text without spans of more than ``most_words`` words."""
    rows, _ = marked(docs, benchmark, s, "*")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    rows = rows.where(hit <= F.col("n_words") * s.most_share).select("row", "text", F.filter("spans", lambda x: x["b"] - x["a"] > s.most_words).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                w = Words(*as_bytes(piece.column("text")), MARKS)
                texts = piece.column("text").to_pylist()
                for row, spans in enumerate(piece.column("spans").to_pylist()):
                    if spans:
                        data, first, zero = texts[row].encode(), int(w.first[row]), int(w.offsets[row])
                        at, out = 0, []
                        for x in spans:
                            out.append(data[at: int(w.start[first + x["a"]]) - zero])
                            at = int(w.end[first + x["b"] - 1]) - zero
                        texts[row] = b"".join([*out, data[at:]]).decode()
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    kind = rows.select("row").schema["row"].dataType.simpleString()
    done = rows.mapInArrow(run, f"row {kind}, text string")
    return done.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
