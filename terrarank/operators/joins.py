"""Joins that assemble the wide table: spine, fallbacks, remaps, repairs and comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rank


def assert_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows, failing the job if a key repeats (an aggregation, so a bad key never fans out a join)."""
    values = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in values])
    ok = F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate key: "), F.concat_ws(",", *[F.col(k).cast("string") for k in key])))
    return one.filter(ok.isNull()).drop("_n")


def join_sources(spine: DataFrame, key: str, sources: Mapping[str, DataFrame | None]) -> DataFrame:
    """Left-join every available source onto the spine; absent sources are skipped, keys must be unique."""
    out = spine
    for source in sources.values():
        if source is not None:
            out = out.join(assert_unique(source, [key]), key, "left")
    return out


def source_coverage(wide: DataFrame, markers: Mapping[str, Sequence[str]]) -> DataFrame:
    """% of rows with any value of each source, in one aggregation."""
    aggs = [(100 * F.avg(F.when(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull(), 1.0).otherwise(0.0))).alias(name)
            for name, cols in markers.items()]
    return wide.agg(*aggs).unpivot([], list(markers), "source", "coverage")


def remap_key(df: DataFrame, key: str, table: DataFrame, old: str, new: str) -> DataFrame:
    """Keys replaced through a code table; others unchanged."""
    codes = table.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return df.join(codes, F.col(key) == F.col("_old"), "left").withColumn(key, F.coalesce("_new", key)).drop("_old", "_new")


def rekey_by_name(rows: DataFrame, key: str, name: str, current: DataFrame) -> DataFrame:
    """Keys missing from ``current`` take the one current row with the same name key — only if exactly one
    has it and no row already uses that key."""
    unique = current.groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("_n"), F.min(key).alias("_new")).filter(F.col("_n") == 1)
    known = current.select(F.col(key).alias("_known")).distinct()
    taken = rows.select(F.col(key).alias("_taken")).distinct()
    out = rows.join(known, F.col(key) == F.col("_known"), "left").join(unique, F.col(name) == F.col("_name"), "left")
    out = out.join(taken, F.col("_new") == F.col("_taken"), "left")
    fix = F.col("_known").isNull() & F.col("_new").isNotNull() & F.col("_taken").isNull()
    return out.withColumn(key, F.when(fix, F.col("_new")).otherwise(F.col(key))).select(*rows.columns)


def with_fallback(rows: DataFrame, levels: Sequence[tuple[str, DataFrame, str]], value: Sequence[str], source: str = "level") -> DataFrame:
    """Values from the first level that has them; which level and key they came from is recorded.

    ``levels``: (name, table, join column), in order of preference.
    """
    out = rows
    for i, (_, table, on) in enumerate(levels):
        renamed = table.select(on, F.struct(*[F.col(v) for v in value]).alias(f"_v{i}"))
        out = out.join(renamed, on, "left")
    picked = F.coalesce(*[F.col(f"_v{i}") for i in range(len(levels))])
    level, origin = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, _, on) in reversed(list(enumerate(levels))):
        has = F.col(f"_v{i}").isNotNull()
        level, origin = F.when(has, F.lit(name)).otherwise(level), F.when(has, F.col(on).cast("string")).otherwise(origin)
    out = out.withColumns({source: level, f"{source}_key": origin, "_p": picked})
    return out.select(*rows.columns, *[F.col(f"_p.{v}").alias(v) for v in value], source, f"{source}_key")


def apply_facts(places: DataFrame, facts: DataFrame, state: str, metrics: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """State facts as place columns: numbers for metrics, text for categories; a gap stays NULL."""
    wanted = [*metrics, *categories]
    cols = [F.max(F.when(F.col("law") == m, F.coalesce(F.col("value_numeric"), F.col("value").try_cast("double")))).alias(m) for m in metrics]
    cols += [F.max(F.when(F.col("law") == c, F.col("value"))).alias(c) for c in categories]
    wide = facts.filter(F.col("law").isin(*wanted)).groupBy(state).agg(*cols)
    return places.join(wide, state, "left")


def full_outer(tables: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(key), "full"), tables)


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and which side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("only_in", F.lit("left")).unionByName(
        b.join(a, key, "left_anti").withColumn("only_in", F.lit("right")))


def build_diff(old: DataFrame, new: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """Changed rows per column (numbers rounded, unknowns equal), and columns that came or went."""
    numeric = {f.name for f in new.schema if f.dataType.typeName() in ("double", "float")}
    both = [c for c in old.columns if c in new.columns and c != key]
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in both])
    joined = o.join(new.select(key, *both), key)
    def same(c: str) -> Column:
        a, b = F.col(f"_o_{c}"), F.col(c)
        return (F.round(a, digits).eqNullSafe(F.round(b, digits))) if c in numeric else a.eqNullSafe(b)
    counts = joined.agg(*[F.count_if(~same(c)).alias(c) for c in both]).unpivot([], both, "column", "changed")
    changed = counts.filter(F.col("changed") > 0).withColumn("what", F.lit("changed"))
    for frame, names, what in ((new, [c for c in new.columns if c not in old.columns], "new column"),
                               (old, [c for c in old.columns if c not in new.columns], "gone")):
        for c in names:
            changed = changed.unionByName(frame.agg(F.count("*").alias("changed")).select(F.lit(c).alias("column"), "changed", F.lit(what).alias("what")))
    return changed


def group_diff(old: DataFrame, new: DataFrame, group: str, value: str) -> DataFrame:
    """Row count and value per group before and after, where either changed."""
    def by(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(F.coalesce(F.col(group), F.lit("(none)")).alias(group)).agg(
            F.count("*").alias(f"rows_{tag}"), F.round(F.max(value)).alias(f"value_{tag}"))
    j = by(old, "before").join(by(new, "after"), group, "full").na.fill(0, ["rows_before", "rows_after"])
    return j.filter((F.col("rows_before") != F.col("rows_after")) | ~F.col("value_before").eqNullSafe(F.col("value_after")))


def compare_places(places: DataFrame, key: str, chosen: Sequence, measures: Sequence[str]) -> DataFrame:
    """Chosen places side by side: one row per measure, one column per place."""
    rows = rank.unpivot(places.filter(F.col(key).isin(*chosen)), [key], measures)
    return rows.groupBy("metric").pivot(key, list(chosen)).agg(F.max("value"))


def candidate_match(rows: DataFrame, key: str, candidates: Sequence[tuple[str, DataFrame, Sequence[str]]], target: str,
                    order: Sequence[str] = ()) -> DataFrame:
    """First match over several candidate tables tried in order: (how, table, join columns). Within one
    table, ``order`` breaks ties. Rows without any match keep NULLs."""
    found = None
    for i, (how, table, on) in enumerate(candidates):
        # the first candidate of each name before any row meets it: a row joins one candidate, however many share the name
        first = table.groupBy(*on).agg(F.min(F.struct(*[c for c in order if c != key], F.col(target).alias("t"))).alias("_c"))
        hit = rows.select(key, *on).join(first, list(on)).groupBy(key).agg(
            F.min(F.struct(F.lit(i).alias("i"), "_c.*", F.lit(how).alias("how"))).alias("_m"))
        hit = hit.select(key, F.struct(F.col("_m.i").alias("i"), F.col("_m.t").alias("t"), F.col("_m.how").alias("how")).alias("_m"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(key).agg(F.min("_m").alias("_m"))
    return rows.join(best, key, "left").select(*rows.columns, F.col("_m.t").alias(target), F.col("_m.how").alias("matched_by"))


def undo_overserved(matched: DataFrame, key: str, target: str, how: str, population: str, capacity: DataFrame, capacity_column: str,
                    max_ratio: float = 2.0) -> DataFrame:
    """Drop matches made by ``how`` whose target would serve more than ``max_ratio`` times its own people."""
    served = matched.filter(F.col(target).isNotNull()).groupBy(target).agg(F.sum(F.coalesce(population, F.lit(0))).alias("_served"))
    too_big = served.join(capacity.select(target, capacity_column), target).filter(
        F.col("_served") > max_ratio * F.col(capacity_column)).select(target, F.lit(True).alias("_undo"))
    out = matched.join(too_big, target, "left")
    undo = F.coalesce("_undo", F.lit(False)) & (F.col("matched_by") == how)
    return out.withColumns({target: F.when(~undo, F.col(target)), "matched_by": F.when(~undo, F.col("matched_by"))}).drop("_undo")


def order_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Listed columns first; the others follow in their own order."""
    present = [c for c in first if c in df.columns]
    return df.select(*present, *[c for c in df.columns if c not in present])
