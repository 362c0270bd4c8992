"""Incremental refresh: replace partitions, keep the live table when a source breaks, patch columns, upsert.

Nothing is edited in place: each step returns the new table, and writing replaces whole partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import replace_flags

# Fixed value: a fresh table with fewer known rows than this share of the live one is broken.
COLLAPSE = 0.95


def union_dedupe(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union of the frames with one row per key: the first frame's row wins."""
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    values = [c for c in out.columns if c not in key and c != "_src"]
    best = out.groupBy(*key).agg(F.min(F.struct("_src", *values)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in values])


def replace_partitions(live: DataFrame | None, fresh: DataFrame, partition: str, replaced: DataFrame) -> DataFrame:
    """The live table without the replaced partitions, plus the fresh rows; columns one side lacks are NULL."""
    if live is None:
        return fresh
    kept = live.join(replaced.select(partition).distinct(), partition, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def overwrite_partitions(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Write so that only the partitions present in ``df`` are replaced; few files each, however large one is."""
    df.hint("rebalance", *[F.col(c) for c in partition]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def merge_live(live: DataFrame, local: DataFrame, group: str) -> DataFrame:
    """Groups rebuilt locally replace the live ones; absent columns read as unknown."""
    return replace_partitions(live, local, group, local)


def coverage_check(fresh: DataFrame, live: DataFrame, partition: str, value: str, replaced: DataFrame) -> DataFrame:
    """One row: known rows fresh and live over the same partitions, and whether the source collapsed."""
    scope = replaced.select(partition).distinct()
    now = fresh.agg(F.count(value).alias("now"))
    was = live.join(scope, partition, "left_semi").agg(F.count(value).alias("was"))
    both = now.join(F.broadcast(was), F.lit(True))  # one row each
    return both.withColumn("collapsed", (F.col("was") > 0) & (F.col("now") < COLLAPSE * F.col("was")))


@dataclass(frozen=True)
class Carried:
    table: DataFrame
    carried: bool
    known_now: int
    known_before: int


def carry_over(fresh: DataFrame | None, live: DataFrame | None, partition: str, value: str, replaced: DataFrame) -> Carried:
    """The fresh rows merged in, or the live table unchanged when the source failed or collapsed.

    Reads one row of counts to decide. Without anything live a failed source is an error.
    """
    if fresh is None:
        if live is None:
            raise ValueError("the source failed and nothing is live to fall back to")
        return Carried(live, True, 0, live.agg(F.count(value)).first()[0])
    if live is None:
        return Carried(fresh, False, fresh.agg(F.count(value)).first()[0], 0)
    check = coverage_check(fresh, live, partition, value, replaced).first()
    if check["collapsed"]:
        return Carried(live, True, check["now"], check["was"])
    return Carried(replace_partitions(live, fresh, partition, replaced), False, check["now"], check["was"])


def merge_columns(base: DataFrame, patch: DataFrame, key: Sequence[str], columns: Sequence[str], only_missing: bool = False,
                  flags: str | None = None, clear: Sequence[str] = (), rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Replace only the named columns from a patch, then recompute the named flags.

    Rows without a patch keep what they have. ``only_missing`` fills columns the base lacks and leaves known
    values. Running it again changes nothing.
    """
    p = patch.select(*key, *[F.col(c).alias(f"_p_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = base
    for c in columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(patch.schema[c].dataType))
    out = out.join(p, list(key), "left")
    new = {}
    for c in columns:
        patched = F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c))
        new[c] = F.coalesce(F.col(c), F.col(f"_p_{c}")) if only_missing else patched
    out = out.withColumns(new).drop("_hit", *[f"_p_{c}" for c in columns])
    if flags is not None:
        out = out.withColumn(flags, replace_flags(flags, clear, rules or {}))
    return out


def annualize_once(df: DataFrame, rates: Sequence[str], months: str, note: Column, marker: str = "crime_note") -> DataFrame:
    """Partial-year rates scaled to a year and inadmissible ones dropped; the marker column shows it was
    done, so a second run changes nothing. ``note`` reads the scaled rates."""
    if marker in df.columns:
        return df
    scale = F.lit(12) / F.when(F.col(months) > 0, F.col(months))
    has = F.col(rates[0]).isNotNull() & (F.col(months) > 0)
    scaled = df.withColumns({c: F.when(has, F.col(c) * scale).otherwise(F.col(c)) for c in rates})
    scaled = scaled.withColumn(marker, F.when(has, note))
    whole = lambda c: F.when(F.col(months) < 12, F.bround(F.col(c))).otherwise(F.col(c))
    return scaled.withColumns({c: F.when(F.col(marker).isNull(), F.when(has, whole(c)).otherwise(F.col(c))) for c in rates})


def move_topcodes(df: DataFrame, caps: Mapping[str, float], topcoded: str = "topcoded", flags: str = "low_confidence") -> DataFrame:
    """Values at a cap are noted as top-coded and lose the low-confidence flag of the same name."""
    at_cap = {c: F.col(c) >= cap for c, cap in caps.items()}
    names = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(c)) for c, cond in at_cap.items()]))
    return df.withColumn("_t", names).withColumns({
        topcoded: F.array_union(F.col(topcoded), F.col("_t")), flags: F.array_except(F.col(flags), F.col("_t"))}).drop("_t")
