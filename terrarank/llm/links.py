"""Links between items that share buckets: each pair is verified once, counted, and never written out.

A pair counts in the smallest bucket that both share, so it counts once however often it meets. A bucket of more than
``block`` items is dealt out as pairs of blocks. Each task sends back, per item, the sum of weights it is linked to and the
smallest item its links lead to within the block: as many rows as items, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import forget

BLOCK = 512

Kernel = Callable[[list[memoryview], np.ndarray, np.ndarray], np.ndarray]


def live_buckets(entries: DataFrame) -> DataFrame:
    """(id, buckets) of items that share one: buckets of one item go, and of buckets with the same items one stays.

    ``entries``: (id, bucket), made durable by the caller, since it is read twice.
    """
    own = F.xxhash64("id", F.lit(1)).cast("decimal(20,0)"), F.xxhash64("id", F.lit(2)).cast("decimal(20,0)")
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(own[0]).alias("s1"), F.sum(own[1]).alias("s2")).where("n > 1")
    alike = sizes.groupBy("n", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return entries.join(alike, "bucket").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("buckets"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal (bucket, i, j) of a sorted stream, as one table each."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "i", "j")], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(k[a])
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _met_before(lists: list[np.ndarray], bucket: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the rows ``a`` x ``b`` share a bucket smaller than this one."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    value = np.concatenate(lists)
    earlier = value < bucket
    row, value = row[earlier], value[earlier]
    found, at, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    out = np.zeros((len(a), len(b)), bool)
    columns, at = np.unique(at[shared], return_inverse=True)
    for c in range(0, len(columns), 4096):
        inside = (at >= c) & (at < c + 4096)
        holds = np.zeros((len(lists), min(4096, len(columns) - c)), np.float32)
        holds[row[shared][inside], at[inside] - c] = 1
        out |= holds[a] @ holds[b].T > 0
    return out


def _labels(linked: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row's links lead to inside the block."""
    label = ids.copy()
    pairs = np.nonzero(linked)
    x, y = a[pairs[0]], b[pairs[1]]
    while len(x):
        low = np.minimum(label[x], label[y])
        if (low == label[x]).all() and (low == label[y]).all():
            break
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
    return label


def linked(items: DataFrame, kernel: Kernel, block: int = BLOCK) -> DataFrame:
    """(id, links, label) per item and block with a link. ``items``: id, weight, data (binary), buckets (of ``live_buckets``)."""
    pieces = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("pieces")).cast("int")
    rows = (items.select("id", "weight", "data", F.transform("buckets", lambda x: x["bucket"]).alias("all"), F.explode("buckets").alias("at"))
            .select("id", "weight", "data", "all", "at.bucket", "at.n").withColumn("pieces", pieces).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
            .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "weight", "data", "all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        kept = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["id", "links", "label"])

        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            bucket, i, j = (group.column(c)[0].as_py() for c in ("bucket", "i", "j"))
            own_block = group.column("own").to_numpy()
            a = np.arange(group.num_rows) if i == j else np.flatnonzero(own_block == i)
            b = a if i == j else np.flatnonzero(own_block == j)
            if not len(a) or not len(b):
                continue
            lists = [np.asarray(x.values.to_numpy()) for chunk in group.column("all").chunks for x in chunk]
            data = [memoryview(x.as_buffer()) for chunk in group.column("data").chunks for x in chunk]
            ids, weight = group.column("id").to_numpy(), group.column("weight").to_numpy()
            near = kernel(data, a, b) & (ids[a][:, None] != ids[b][None, :])
            if not near.any():
                continue
            near &= ~_met_before(lists, bucket, a, b)
            if not near.any():
                continue
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, a, near @ weight[b])
            if i != j:
                np.add.at(links, b, near.T @ weight[a])
            label, some = _labels(near, a, b, ids), links > 0
            out.append((ids[some], links[some], label[some]))
            kept += int(some.sum())
            if kept > 10_000:
                yield flush()
                out, kept = [], 0
        if out:
            yield flush()

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "id long, links long, label long")
