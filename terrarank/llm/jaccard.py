"""Operator 6, n-gram Jaccard join: chosen paths (Christiani, Pagh and Sivertsen, 2018).

A document is the set of its runs of ``width`` words (words: see ``text``; a shorter text is one run), and a sketch of that set:
its least token under each of ``positions`` random orders. Two sets agree at a position with their Jaccard similarity as
probability. Each run grows a tree. A node has a path, which decides the positions that are chosen there: ``1 / threshold`` of them
in the mean. For each, a set goes on to the child named by its token at that position, so similar sets stay together on one path in
the mean, others on ever fewer. Nodes are split, level by level, while they hold more than ``limit`` sets; nodes whose sets are alike
in the mean (``similar``, from counted tokens of some) end there, since their pairs are results. What remains is compared by brute force, in
blocks where it is still large, so nothing is capped.

The chance that a pair at the threshold shares a path down to a level follows from the number of positions where it agrees, which is
binomial; ``Settings.runs`` gives the runs after which pairs are missed with at most ``1 - recall``. All sets take the runs for the
first ``start`` levels (12 for a millionth); sets that met in a node split beyond take the further runs for the deepest level reached.

Texts of the same words in the same order are one item with a weight. Every verified pair is exact: sets of 64-bit hashes.

Edges: null text is empty text; texts without words link with nothing and are their own class; rows that share a
doc_id are one document in ``join``, and judged by their texts in ``one_of_each``; a null doc_id stays null, comes before all others
and ties no rows together; an empty table gives an empty result; other
columns are ignored, or pass in ``one_of_each``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_checked, durable
from .components import components
from .links import linked, live_buckets
from .text import Words, as_bytes, forget, free_names, mix, seeds, shingles, slices

NO_ID = -(2**63)   # stands for a null doc_id
PROBES = 32          # positions from which the similarity inside a node is estimated,
PROBED = 256         # and the sets, in the mean; this decides whether a node is split, never what is compared


@dataclass(frozen=True)
class Settings:
    width: int = 5
    threshold: float = 0.8
    recall: float = 0.999999
    limit: int = 2048      # larger nodes are split; below, the further runs cost more comparisons and copies of texts than they save
    start: int = 2         # levels that all sets take at once
    depth: int = 12        # levels at most
    similar: float = 0.72  # mean similarity from which a node is compared as it is
    positions: int = 128
    seed: int = 6

    def shared(self, agree: float, depth: int) -> float:
        """The chance that two sets which agree at this share of positions have a path of ``depth`` levels in common."""
        few, more = divmod(1 / self.threshold, 1)
        chance = 1.0
        for _ in range(depth):
            lost = 1 - agree * chance
            chance = (1 - more) * (1 - lost ** few) + more * (1 - lost ** (few + 1))
        return chance

    def runs(self, depth: int) -> int:
        """Runs after which pairs at the threshold have met in a node of ``depth`` with ``recall``."""
        n, t = self.positions, self.threshold
        agree = [math.comb(n, k) * t ** k * (1 - t) ** (n - k) for k in range(n + 1)]
        missed = [1 - self.shared(k / n, depth) for k in range(n + 1)]
        runs = 1
        while sum(a * m ** runs for a, m in zip(agree, missed)) > 1 - self.recall:
            runs += 1
        return runs


def _halves(w: Words) -> list[pa.Array]:
    """A digest of each text's words in order, as two numbers; null without words."""
    digest = [xxhash.xxh3_128_intdigest(w.hash[a:b].tobytes()) if b > a else None for a, b in zip(w.first, w.first[1:])]
    return [pa.array([None if d is None else ((d >> shift) & (2**64 - 1)) - 2**63 for d in digest], pa.int64()) for shift in (0, 64)]


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, two halves of a digest of the words in order, and the sketch: 16 bits of the least token in each order.

    Texts without words have null halves and no sketch.
    """
    by = seeds(settings.positions, settings.seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch):
                w = Words(*as_bytes(piece.column("text")))
                tokens, row = shingles(w, settings.width)
                has, first = np.unique(row, return_index=True)
                least = np.zeros((w.rows, len(by)), np.uint16)
                for k, b in enumerate(by if len(has) else ()):
                    h = (tokens ^ (b >> np.uint64(7))) * b
                    h ^= h >> np.uint64(32)
                    h *= b
                    least[has, k] = (mix(np.minimum.reduceat(h, first)) >> np.uint64(48)).astype(np.uint16)
                drawn = pa.array([v.tobytes() if n else None for v, n in zip(least, w.count)], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").fill_null(NO_ID), *_halves(w), drawn], names=["doc_id", "k1", "k2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, k1 long, k2 long, sketch binary")


def _values(column: pa.Array, positions: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint16).reshape(len(column), positions)


def children(row: np.ndarray, path: np.ndarray, values: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and paths one level down: the path alone decides which positions are chosen, the set's tokens there where it goes."""
    n = np.uint64(values.shape[1])
    drawn = mix(path ^ np.uint64(0x9E3779B97F4A7C15))
    many = np.floor(1 / threshold + (mix(drawn) >> np.uint64(11)) / 2.0**53).astype(np.int64)
    first, step = drawn % n, np.uint64(1) + (drawn >> np.uint64(32)) % max(n - np.uint64(1), np.uint64(1))
    rows, paths = [], []
    for i in range(int(many.max(initial=0))):
        go = many > i
        at = (first[go] + np.uint64(i) * step[go]) % n
        token = values[row[go], at.astype(np.int64)].astype(np.uint64)
        rows.append(row[go])
        paths.append(mix(path[go] + mix(token ^ (at << np.uint64(32)))))
    return (np.concatenate(rows), np.concatenate(paths)) if rows else (row[:0], path[:0])


def started(sets_: DataFrame, first: int, last: int, settings: Settings) -> DataFrame:
    """(id, bucket): the nodes of each set after ``start`` levels, in the runs from ``first`` up to ``last``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(first, last, dtype=np.uint64) + np.uint64(settings.seed << 32))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                piece = batch.slice(i, 4096)
                values = _values(piece.column("sketch"), settings.positions)
                row, path = np.repeat(np.arange(len(values)), len(roots)), np.tile(roots, len(values))
                for _ in range(settings.start):
                    row, path = children(row, path, values, settings.threshold)
                yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(row)), pa.array(path.view(np.int64))], names=["id", "bucket"])

    return sets_.select("id", "sketch").mapInArrow(run, "id long, bucket long")


def _split(entries: DataFrame, settings: Settings) -> DataFrame:
    """(id, bucket) one level down, of (id, bucket, sketch)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                path = batch.column("bucket").to_numpy().view(np.uint64)
                row, path = children(np.arange(batch.num_rows), path, _values(batch.column("sketch"), settings.positions), settings.threshold)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(path.view(np.int64))], names=["id", "bucket"])

    return entries.select("id", "bucket", "sketch").mapInArrow(run, "id long, bucket long")


def _probed(entries: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, at, token) of every set in a node at a few positions, the same for all its sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bucket = batch.column("bucket").to_numpy()
                values = _values(batch.column("sketch"), settings.positions)
                at = ((mix(bucket.view(np.uint64))[:, None] >> np.uint64(8)) + np.arange(PROBES, dtype=np.uint64) * np.uint64(settings.positions // PROBES)) % np.uint64(settings.positions)
                token = np.take_along_axis(values, at.astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket, PROBES)), pa.array(np.tile(np.arange(PROBES, dtype=np.int32), len(bucket))),
                                                  pa.array(token.ravel().astype(np.int64))], names=["bucket", "at", "token"])

    return entries.select("bucket", "sketch").mapInArrow(run, "bucket long, at int, token long")


def _settled(entries: DataFrame, sets_: DataFrame, settings: Settings, depth: int) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Nodes of several sets that need no more splitting, as durable tables of (id, bucket); the sets that were split on; the deepest level."""
    done, went = [], []
    for level in range(settings.start, depth):
        shared = durable(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
        entries = durable(entries.join(shared.select("bucket"), "bucket", "left_semi"))   # read up to three times below
        large = durable(shared.where(F.col("n") > settings.limit))
        if large.isEmpty():
            return [*done, entries], went, level
        sketch = sets_.select("id", "sketch")
        some = F.pmod(F.xxhash64("id", "bucket"), F.col("n")) < PROBED
        members = entries.join(broadcast_checked(large), "bucket").where(some)
        counts = _probed(members.join(sketch, "id"), settings).groupBy("bucket", "at", "token").agg(F.count("*").cast("double").alias("c"))
        pairs = counts.groupBy("bucket").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"), (F.sum("c") / PROBES).alias("m"))
        mixed = durable(pairs.where(F.col("pairs") < settings.similar * PROBES * F.col("m") * (F.col("m") - 1)).select("bucket"))
        if mixed.isEmpty():
            return [*done, entries], went, level
        split = durable(entries.join(broadcast_checked(mixed), "bucket"))
        done.append(durable(entries.join(broadcast_checked(mixed), "bucket", "left_anti")))
        went.append(split.select("id").distinct())
        entries = durable(_split(split.join(sketch, "id"), settings))
    return [*done, entries], went, depth


def nodes(sets_: DataFrame, settings: Settings) -> DataFrame:
    """(id, bucket) of all nodes whose sets are to be compared, durable. ``sets_``: (id, sketch), durable, one row per text."""
    first = settings.runs(settings.start)
    ends, went, deepest = _settled(durable(started(sets_, 0, first, settings)), sets_, settings, settings.depth)
    if went:
        again = durable(reduce(DataFrame.union, went).distinct().join(sets_, "id").select("id", "sketch"))
        more = durable(started(again, first, settings.runs(deepest), settings))
        ends += _settled(more, again, settings, deepest)[0]
    return reduce(DataFrame.union, (e.select("id", "bucket") for e in ends))


def sets(docs: DataFrame, width: int) -> DataFrame:
    """All columns but text, the halves of the digest, and ``data``: the sorted 64-bit tokens of the text."""
    others = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch):
                w = Words(*as_bytes(piece.column("text")))
                tokens, row = shingles(w, width)
                cut = np.searchsorted(row, np.arange(piece.num_rows + 1))
                data = [np.unique(tokens[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([*(piece.column(f.name) for f in others), *_halves(w), pa.array(data, pa.binary())],
                                                 names=[*(f.name for f in others), "k1", "k2", "data"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return docs.mapInArrow(run, f"{kinds}, k1 long, k2 long, data binary")


def jaccard_kernel(threshold: float):
    """Exact similarities of sets: tokens that only one of them holds can be left out of the intersections."""
    def kernel(data: list[memoryview], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        tokens = [np.frombuffer(x, np.uint64) for x in data]
        size = np.array([len(x) for x in tokens])
        row = np.repeat(np.arange(len(tokens)), size)
        _, at, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        shared = times[at] > 1
        row, (columns, at) = row[shared], np.unique(at[shared], return_inverse=True)
        both = np.zeros((len(a), len(b)))
        for c in range(0, len(columns), 4096):
            inside = (at >= c) & (at < c + 4096)
            holds = np.zeros((len(tokens), min(4096, len(columns) - c)), np.float32)
            holds[row[inside], at[inside] - c] = 1
            both += holds[a] @ holds[b].T   # whole numbers below 2**24: exact
        return both / (size[a][:, None] + size[b][None, :] - both) >= threshold
    return kernel


def keyed(docs: DataFrame, k1: str, k2: str) -> DataFrame:
    """All columns, and the halves of the digest under these names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch):
                yield pa.RecordBatch.from_arrays([*piece.columns, *_halves(Words(*as_bytes(piece.column("text"))))], names=[*piece.schema.names, k1, k2])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, {k1} long, {k2} long")


def _classes(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The sketches, and per text (k1, k2): weight, links and the first text of its class by links of texts alone, as (low, f1, f2).

    Texts are known by their digest throughout, so rows of one id, or without one, never meet because of it.
    """
    drawn = durable(sketches(docs, settings))
    # numbers once written: unlike hashes of the digest, no two texts can share one
    classes = durable(drawn.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("low"), F.count("*").alias("weight"), F.first("sketch").alias("sketch")).withColumn("id", F.monotonically_increasing_id()))
    live = live_buckets(nodes(classes.select("id", "sketch"), settings))
    # the text of each item: a row with its smallest doc_id and its digest
    wanted = classes.select("id", "weight", "low", F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).join(live, "id")
    texts = keyed(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("low"), "text"), "__k1", "__k2").join(wanted.hint("shuffle_hash"), ["low", "__k1", "__k2"])
    items = sets(texts.drop("low", "__k1", "__k2"), settings.width).dropDuplicates(["id", "k1", "k2"])
    found = durable(linked(items, jaccard_kernel(settings.threshold)))
    reach = components(found.select("id", "label"))
    totals = found.groupBy("id").agg(F.sum("links").alias("links"))
    own = F.struct(F.col("low"), F.col("k1").alias("f1"), F.col("k2").alias("f2"))
    known = durable(classes.select("k1", "k2", "id", "low", "weight").join(totals, "id", "left").join(reach, "id", "left"))
    firsts = durable(known.where("component IS NOT NULL").groupBy("component").agg(F.min(own).alias("first")))
    known = known.join(broadcast_checked(firsts), "component", "left").select(
        "k1", "k2", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", own).alias("first"))
    return drawn, durable(known.select("k1", "k2", "weight", "links", "first.*"))


def join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every row.

    ``class_id``: the smallest doc_id that links lead to. ``n_links``: rows at the threshold or above, copies included.
    ``n_copies``: rows of the same words, itself included.
    """
    drawn, known = _classes(docs, settings)
    rows = durable(drawn.select("doc_id", "k1", "k2").join(known, ["k1", "k2"], "left").select(
        "doc_id", F.coalesce("low", "doc_id").alias("low"), "weight", "links"))
    # rows that share a doc_id are one document: where their texts' classes differ, these are one
    several = rows.where(F.col("doc_id") != NO_ID).groupBy("doc_id").agg(F.min("low").alias("a"), F.max("low").alias("b")).where("a <> b")
    ties = durable(rows.join(several.select("doc_id"), "doc_id", "left_semi").select("low", "doc_id").distinct())
    merged = components(ties).withColumnsRenamed({"id": "low", "component": "to"})
    own = lambda c: F.when(c != NO_ID, c)
    return rows.join(broadcast_checked(durable(merged)), "low", "left").select(
        own(F.col("doc_id")).alias("doc_id"), own(F.coalesce("to", "low")).alias("class_id"),
        (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("weight", F.lit(1)).cast("long").alias("n_copies"))


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of the first text of each class with its smallest doc_id, with all their columns; classes are of texts, whatever their ids."""
    drawn, known = _classes(docs, settings)
    id_, k1, k2, g1, g2 = free_names(docs, "__gone", "__k1", "__k2", "__g1", "__g2")
    gone = drawn.select("doc_id", "k1", "k2").join(known, ["k1", "k2"]).where("doc_id <> low OR k1 <> f1 OR k2 <> f2").select(
        F.col("doc_id").alias(id_), F.col("k1").alias(g1), F.col("k2").alias(g2)).distinct()
    rows = keyed(docs, k1, k2)
    same = (F.coalesce(rows["doc_id"].cast("long"), F.lit(NO_ID)) == F.col(id_)) & (F.col(k1) == F.col(g1)) & (F.col(k2) == F.col(g2))
    return rows.join(gone, same, "left_anti").drop(k1, k2)
