"""Bootstrap replicates as vectors: each record draws all its replicates at once, and a group's sums are arrays that add up.

Nothing is exploded: a task holds, per group, one array of sums per replicate, and sends one row per group; rows of a group
are added where they meet. Draws come from a hash that mixes key and replicate, so they repeat on any engine and under lost
executors, and no replicate follows from another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 32-bit finalizer of MurmurHash3, the golden ratio's step, and the distribution of a Poisson(1) count.
MIX = (16, 2246822507, 13, 3266489909, 16)
STEP = 2654435761
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)

ROWS, GROUPS = 2048, 4096   # records drawn at once, groups held by a task at most
_LEAST = [np.uint32(math.ceil(p * 2 ** 32 - 0.5)) for p in POISSON]


def mixed(h: np.ndarray) -> np.ndarray:
    """All bits of each 32-bit number depend on all bits of it."""
    h = h.astype(np.uint32)
    for k, by in zip((0, 2), (MIX[1], MIX[3])):
        h = (h ^ (h >> np.uint32(MIX[k]))) * np.uint32(by)
    return h ^ (h >> np.uint32(MIX[4]))


def counts(seeds: np.ndarray, replicates: int, stream: int = 0) -> np.ndarray:
    """Poisson(1) counts, rows x replicates: how often each record is in each resample."""
    low, high = (seeds & 0xFFFFFFFF).astype(np.uint32), ((seeds >> 32) & 0xFFFFFFFF).astype(np.uint32)
    start = mixed(low ^ mixed(high) ^ mixed(np.array([stream]))[0])
    steps = (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(STEP)).astype(np.uint32)
    h = mixed(start[:, None] + steps[None, :])
    out = np.zeros(h.shape, np.uint8)
    for least in _LEAST:
        out += h >= least
    return out


def resampled_sums(df: DataFrame, by: Sequence[str], seed: Column, values: dict[str, Column], replicates: int, stream: int = 0) -> DataFrame:
    """``by`` and, per value, the array of its sums over the resamples; unknown values add nothing.

    ``seed``: a whole number per record (its key, or a hash of it).
    """
    names, keys = list(values), list(by)
    rows = df.select(*keys, seed.cast("long").alias("_seed"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_v{i}") for i, c in enumerate(values.values())])
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*keys).schema}
    schema = ", ".join([*(f"`{k}` {t}" for k, t in kinds.items()), *(f"`{n}` array<double>" for n in names)])

    def table(held: dict[tuple, np.ndarray], like: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], like.schema.field(name).type) for i, name in enumerate(keys)]
        sums = [pa.array([s[i] for s in held.values()], pa.list_(pa.float64())) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*columns, *sums], names=[*keys, *names])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                piece = batch.slice(a, ROWS)
                code: dict[tuple, int] = {}
                groups = np.array([code.setdefault(k, len(code)) for k in zip(*(piece.column(name).to_pylist() for name in keys))])
                order = np.argsort(groups, kind="stable")
                drawn = counts(piece.column("_seed").to_numpy()[order], replicates, stream).astype(np.float64)
                v = np.stack([piece.column(f"_v{i}").to_numpy()[order] for i in range(len(names))])
                cuts = np.searchsorted(groups[order], np.arange(len(code) + 1))
                for key, x, y in zip(code, cuts, cuts[1:]):
                    now = v[:, x:y] @ drawn[x:y]
                    held[key] = held[key] + now if key in held else now
                if len(held) > GROUPS:
                    yield table(held, batch)
                    held = {}
        if held:
            yield table(held, batch)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            sums = [batch.column(n) for n in names]
            for i, now in enumerate(zip(*(batch.column(name).to_pylist() for name in keys))):
                row = np.stack([s[i].values.to_numpy() for s in sums])
                if total is not None and now != key:
                    yield table({key: total}, batch)
                    total = None
                key, total = now, row if total is None else total + row
        if total is not None:
            yield table({key: total}, batch)

    parts = rows.mapInArrow(draw, schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, schema)
