"""Operator 11, embedding whitening: weighted multiplicity covariance.

Entries are counted in steps of ``1 / step`` and become whole numbers x. Identical x vectors are one row with the number of
their copies, so a hot vector costs one row from here on. The copies (or ones, with ``weighted=False``) are the weights of the
fit: sums per dimension are exact whole numbers, each x is centred as a whole number and a fraction, and every task multiplies
its centred rows once (GEMM). Tasks send d x d partial products by matrix row, which are added per row. Only d sums and the
d x d covariance come to the driver, which finds the eigenvectors; each distinct vector is whitened once, and the result is
joined back to the rows. Vectors that hold more than one row in ``HOT_PARTS`` (fewer than ``HOT_PARTS``, so a broadcast of them
is bounded) are joined by broadcast, the others by a shuffle on x.

Edges: vectors that are null or hold null or a component that is not finite are left out; each length of vector is a list of
its own, with its own n, sums and components; empty vectors have no components and give no rows; entries are held between
-2**53 and 2**53 after the step; components whose eigenvalue is rounding noise (constant or dependent dimensions, one distinct vector)
can't be scaled to one and are left out; ``deviation`` is null where it exceeds 64 bits; rows that share a vec_id, or have
none, get their rows each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .text import forget

HOT_PARTS = 1000
ROWS = 4096                    # rows multiplied at once
HELD, LOW = float(1 << 53), 26  # bounds of an entry; bits of the lower half of a sum


@dataclass(frozen=True)
class Settings:
    step: int = 64
    shift: int = 1_000_000
    components: int = 32
    weighted: bool = True     # copies count in the fit; else each distinct vector counts once


@dataclass(frozen=True)
class Model:
    """One length of vectors: n, the sums as whole numbers, eigenvectors by columns, eigenvalues and their shares."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S) ** 2, exact; null beyond 64 bits."""
        q, r = _divided(self.n, self.sums)
        near = (((x - q).astype(np.float64) * self.n - r) ** 2).sum(1)
        out: list[int | None] = []
        if len(x) and near.max() < 2.0 ** 60:
            return (((x - q) * self.n - r) ** 2).sum(1).tolist()
        for row in x.tolist():
            exact = sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums))
            out.append(exact if exact < 1 << 63 else None)
        return out


def _divided(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    both = [divmod(s, n) for s in sums]
    return np.array([q for q, _ in both], np.int64), np.array([r for _, r in both], np.int64)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    q, r = _divided(n, sums)
    return (x - q) - r / n   # the difference of whole numbers is exact


def counted(vectors: DataFrame, s: Settings) -> DataFrame:
    """vec_id and x of the rows that count."""
    v = F.col("v")
    sound = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    held = lambda c: F.greatest(F.least(c * F.lit(float(s.step)), F.lit(HELD)), F.lit(-HELD))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(sound)
            .select("vec_id", F.transform(v, lambda c: F.floor(held(c)) + F.lit(s.shift)).alias("x")))


def _by_length(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matrix of the column and weights, of rows of one length at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            piece = batch.slice(a, ROWS)
            found = [np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in piece.column(column)]
            size, weight = np.array([len(v) for v in found]), piece.column("weight").to_numpy()
            for d in np.unique(size[size > 0]):
                at = np.flatnonzero(size == d)
                yield np.stack([found[i] for i in at]), weight[at]


def _sums(table: DataFrame) -> DataFrame:
    """d, at, n, high and low: exact sums of x per length and dimension, in halves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for x, w in _by_length(batches, "x"):
            high, low = x >> LOW, x & ((1 << LOW) - 1)
            now = [int(w.sum()), w @ high, w @ low]
            d = x.shape[1]
            total[d] = [a + b for a, b in zip(total[d], now)] if d in total else now
        for d, (n, high, low) in total.items():
            yield pa.RecordBatch.from_pydict({"d": np.full(d, d), "at": np.arange(d), "n": np.full(d, n), "high": high, "low": low})

    parts = table.select("x", "weight").mapInArrow(run, "d long, at long, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    return parts.groupBy("d", "at").agg(wide("n"), wide("high"), wide("low"))


def _products(table: DataFrame, column: str, centre: Callable[[np.ndarray], np.ndarray | None]) -> dict[int, np.ndarray]:
    """Per length the sum of weight * c c' over centred rows c, added in the order of tasks; one d x d matrix each comes back.

    ``centre`` gives None for rows that are not wanted.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total: dict[int, np.ndarray] = {}
        for x, w in _by_length(batches, column):
            c = centre(x)
            if c is not None:
                now = (c * w[:, None]).T @ c
                total[x.shape[1]] = total[x.shape[1]] + now if x.shape[1] in total else now
        part = TaskContext.get().partitionId()
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), d)), pa.array(np.arange(len(m))), pa.array(np.full(len(m), part)), pa.array(list(m), pa.list_(pa.float64()))],
                                             names=["d", "at", "part", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        out = lambda: pa.RecordBatch.from_pydict({"d": [key[0]], "at": [key[1]], "row": [total]})
        for batch in batches:
            for d, at, row in zip(batch.column("d").to_pylist(), batch.column("at").to_pylist(), batch.column("row")):
                if (d, at) != key:
                    if key:
                        yield out()
                    key, total = (d, at), np.zeros(d)
                total = total + np.asarray(row.values.to_numpy())
        if key:
            yield out()

    parts = table.select(column, "weight").mapInArrow(run, "d long, at long, part long, row array<double>")
    rows = parts.repartition("d", "at").sortWithinPartitions("d", "at", "part").mapInArrow(add, "d long, at long, row array<double>").collect()
    out = {r.d: np.zeros((r.d, r.d)) for r in rows}
    for r in rows:
        out[r.d][r.at] = r.row
    return out


def fit(distinct: DataFrame, s: Settings = Settings()) -> dict[int, Model]:
    """A model per length of vectors; ``distinct``: x and weight."""
    sums: dict[int, tuple[int, tuple[int, ...]]] = {}
    for r in _sums(distinct).orderBy("d", "at").collect():
        n, before = sums.get(r.d, (int(r.n), ()))
        sums[r.d] = n, (*before, (int(r.high) << LOW) + int(r.low))

    def centre(x: np.ndarray) -> np.ndarray:
        return _centred(x, *sums[x.shape[1]])

    out = {}
    for d, product in (_products(distinct, "x", centre) if sums else {}).items():
        n, total = sums[d]
        v = (product + product.T) / (2 * n)
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1], vectors[:, ::-1]
        noise = d * np.finfo(float).eps * max(values[0], 0)
        k = min(s.components, int((values > noise).sum()))
        out[d] = Model(n, total, np.ascontiguousarray(vectors[:, :k]), values[:k], values[:k] / np.trace(v) if k else values[:k])
    return out


def _whitened(distinct: DataFrame, models: dict[int, Model]) -> DataFrame:
    """x, weight, copies, whitened and deviation of every distinct vector whose length has components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                piece = batch.slice(a, ROWS)
                found = [np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in piece.column("x")]
                size = np.array([len(v) for v in found])
                for d in np.unique(size):
                    model, at = models.get(int(d)), np.flatnonzero(size == d)
                    if model is not None and len(model.values):
                        x, rows = np.stack([found[i] for i in at]), piece.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays(
                            [*rows.columns, pa.array(list(model.whitened(x)), pa.list_(pa.float64())), pa.array(model.deviation(x), pa.int64())],
                            names=[*rows.schema.names, "whitened", "deviation"])

    return distinct.select("x", "weight", "copies").mapInArrow(run, "x array<long>, weight long, copies long, whitened array<double>, deviation long")


def identity_errors(table: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Per length the largest entry of the whitened vectors' covariance less the identity; ``table``: of ``_whitened``."""
    out = {}
    for d, model in models.items():
        k = len(model.values)
        if not k:
            continue
        own = table.where(F.size("x") == d)
        means = own.select("weight", F.posexplode("whitened").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v") * F.col("weight")).alias("s")).collect()
        mean = np.zeros(k)
        for r in means:
            mean[r.at] = r.s / model.n
        product = _products(own, "whitened", lambda z, mean=mean: z - mean)[k]
        out[d] = float(np.abs(product / model.n - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row per vector and component."""
    spark = vectors.sparkSession
    rows = counted(vectors, s)
    copies = F.count("*").alias("copies")
    distinct = durable(rows.groupBy("x").agg(copies).withColumn("weight", F.col("copies") if s.weighted else F.lit(1).cast("long")))
    models = {d: m for d, m in fit(distinct, s).items() if len(m.values)}
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not models:
        return spark.createDataFrame([], schema)
    table = durable(_whitened(distinct, models))
    errors = identity_errors(table, models)
    total = distinct.agg(F.sum("copies")).first()[0]
    is_hot = F.col("copies") * HOT_PARTS > total
    hot = F.broadcast(table.where(is_hot).select("x", "whitened", "deviation"))   # at most HOT_PARTS rows
    cold = table.where(~is_hot).select("x", "whitened", "deviation")
    found = rows.join(hot, "x").unionByName(rows.join(hot, "x", "left_anti").join(cold, "x"))
    facts = F.create_map(*[c for d, m in models.items() for c in (
        F.lit(d), F.struct(F.lit(m.n).cast("long").alias("n"), F.lit(errors[d]).alias("error"), F.array(*map(F.lit, m.shares.tolist())).alias("shares")))])
    return (found.select("vec_id", "deviation", "whitened", facts[F.size("x")].alias("own"))
            .select("vec_id", "deviation", "own", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.col("own.n").alias("n"), "deviation", "whitened",
                    F.col("own.shares")[F.col("at")].alias("explained"), F.col("own.error").alias("identity_error")))
