"""Ranks, percentiles and running totals that never sort a whole group in one task.

A window over a whole table, or over one group holding a third of it, puts that many rows in one
task. Here every rank is built from three steps that spread:

1. rows collapse to one row per (group, value) with a count — partial aggregation runs before the
   shuffle, so a value shared by a billion rows is one row;
2. those rows are range partitioned by group and value and written to the shared folder with their
   partition's number: a large group simply spans partitions, and a lost task reads the same rows
   again. Order values may be numbers, dates or text;
3. sums per (partition, group), one row each, give every partition its offset inside a group.

The ranks join back on (group, value). A value held by more than ``Limits.hot_rows`` rows is spread
over several tasks by a salt; there are at most rows / ``hot_rows`` of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import DEFAULT_LIMITS, Limits, broadcast_checked, durable


def _on(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], hot: DataFrame, spread_by: Sequence[str],
                how: str = "left", salts: int = DEFAULT_LIMITS.salts) -> DataFrame:
    """An equi-join whose hot keys are spread over ``salts`` tasks.

    ``hot`` holds the hot key values; rows of ``left`` with such a key get a salt from a hash of
    ``spread_by``, and the matching rows of ``right`` are repeated once per salt.
    """
    marked = broadcast_checked(hot.select(*on).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = left.join(marked, list(on), "left").withColumn("_salt", salt).drop("_hot")
    right = right.join(marked, list(on), "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def _ranged(values: DataFrame, by: Sequence[str], order: str, limits: Limits) -> DataFrame:
    """The rows in ranges of (group, order), each with the number of its range (``_p``), durable."""
    keys = [*by, order]
    ranged = values.repartitionByRange(limits.slices, *keys) if limits.slices else values.repartitionByRange(*keys)
    return durable(ranged.withColumn("_p", F.spark_partition_id()))


def _totals(ranged: DataFrame, by: Sequence[str], order: str, measures: Sequence[str]) -> DataFrame:
    """``<m>_before`` and ``<m>_total`` from ranges. Offsets are one row per range and group."""
    columns = [c for c in ranged.columns if c != "_p"]
    run = Window.partitionBy("_p", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged
    for m in measures:
        out = out.withColumn(f"{m}_before", F.sum(m).over(run) - F.col(m))
    each = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = each.orderBy("_o_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(F.col("_p").alias("_o_p"), *by).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    for m in measures:
        offsets = offsets.withColumn(f"_o_{m}", F.coalesce(F.sum(f"_t_{m}").over(earlier), F.lit(0))).withColumn(f"_g_{m}", F.sum(f"_t_{m}").over(each))
    offsets = offsets.drop(*[f"_t_{m}" for m in measures])
    for c in by:
        offsets = offsets.withColumnRenamed(c, f"_o_{c}")
    out = out.join(offsets, _on(out, offsets, [("_p", "_o_p")] + [(c, f"_o_{c}") for c in by]), "left")
    for m in measures:
        out = out.withColumn(f"{m}_before", F.col(f"{m}_before") + F.col(f"_o_{m}")).withColumn(f"{m}_total", F.col(f"_g_{m}"))
    return out.select(*columns, *[f"{m}_{s}" for m in measures for s in ("before", "total")])


def running_totals(values: DataFrame, by: Sequence[str], order: str, measures: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Per row of ``values`` (one per group and order value): ``<m>_before``, the sum of ``m`` over
    smaller order values of its group, and ``<m>_total``, the group's sum.

    Writes ``values`` to the shared folder; what follows is lazy.
    """
    return _totals(_ranged(values, by, order, limits), by, order, measures)


def unpivot(df: DataFrame, keys: Sequence[str], measures: Sequence[str], name: str = "metric",
            value: str = "value") -> DataFrame:
    """Wide measures to long rows; unknown values are dropped (they take no part in ranks)."""
    long = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(
        list(keys), list(measures), name, value)
    return long.filter(F.col(value).isNotNull())


def _ranked(long: DataFrame, by: Sequence[str], value: str, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """One row per (group, value) with ``ties``, ``below`` and ``n``; and the hot ones among these rows."""
    counts = long.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    ranged = _ranged(counts, by, value, limits)
    ranks = _totals(ranged, by, value, ["ties"]).withColumnRenamed("ties_before", "below").withColumnRenamed("ties_total", "n")
    return ranks, ranged.filter(F.col("ties") > limits.hot_rows)


def value_ranks(long: DataFrame, by: Sequence[str], value: str = "value", limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """One row per (group, value): ``ties``, ``below`` and ``n``, all counted over rows of ``long``."""
    return _ranked(long, by, value, limits)[0]


def _join_ranks(rows: DataFrame, ranks: DataFrame, keys: Sequence[str], on: Sequence[str], hot: DataFrame, how: str,
                limits: Limits, keep: Sequence[str]) -> DataFrame:
    """Ranks back onto rows; values shared by very many rows are joined salted."""
    return salted_join(rows, ranks.select(*on, *keep), on, hot, keys, how, limits.salts)


def percent_columns() -> dict[str, Column]:
    """``lo``, ``hi``, ``mid`` (0–100) from ``below``, ``ties`` and ``n``; a lone value sits at 50."""
    rest = F.col("n") - 1
    lo = F.when(rest > 0, F.lit(100.0) * F.col("below") / rest).otherwise(50.0)
    hi = F.when(rest > 0, F.lit(100.0) * (F.col("below") + F.col("ties") - 1) / rest).otherwise(50.0)
    mid = F.when(rest > 0, F.lit(100.0) * ((F.col("below") + F.col("below") + F.col("ties") - 1) / 2) / rest).otherwise(50.0)
    return {"lo": lo, "hi": hi, "mid": mid}


def value_bounds(long: DataFrame, by: Sequence[str], value: str = "value", limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The bounds table: per (group, value) the share of known values strictly below (``lo``), at or
    below less itself (``hi``) and the shared middle rank (``mid``), 0–100.

    Depends only on the values, so one table serves every search over the same rows: make it durable
    and join it as often as needed.
    """
    return value_ranks(long, by, value, limits).select(
        *by, value, "ties", "below", "n", *[c.alias(k) for k, c in percent_columns().items()])


def rank_rows(long: DataFrame, keys: Sequence[str], by: Sequence[str], value: str = "value",
              limits: Limits = DEFAULT_LIMITS, bounds: DataFrame | None = None) -> DataFrame:
    """Rows of ``long`` with ``lo``, ``hi``, ``mid`` and ``n`` of their value.

    ``bounds``: a bounds table made before (see :func:`value_bounds`), so nothing is ranked again.
    """
    if bounds is None:
        ranks, hot = _ranked(long, by, value, limits)
        ranks = ranks.withColumns(percent_columns())
    else:
        ranks, hot = bounds, bounds.filter(F.col("ties") > limits.hot_rows)
    return _join_ranks(long, ranks, keys, [*by, value], hot, "inner", limits, ["lo", "hi", "mid", "n"])


def group_rank(df: DataFrame, keys: Sequence[str], by: Sequence[str], value: str, descending: bool = True,
               limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Competition rank inside each group (1, 2, 2, 4) and the group's known count."""
    ranks, hot = _ranked(df, by, value, limits)
    ahead = F.col("n") - F.col("below") - F.col("ties") if descending else F.col("below")
    ranks = ranks.withColumns({"rank": ahead + 1, "group_count": F.col("n")})
    return _join_ranks(df, ranks, keys, [*by, value], hot, "left", limits, ["rank", "group_count"])


def average_rank_percentile(df: DataFrame, keys: Sequence[str], by: Sequence[str], value: str, out: str,
                            limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """100 × (average rank) / n inside each group; unknown stays unknown."""
    ranks, hot = _ranked(df, by, value, limits)
    pct = F.lit(100.0) * ((F.col("below") + 1 + F.col("below") + F.col("ties")) / 2) / F.col("n")
    return _join_ranks(df, ranks.withColumn(out, pct), keys, [*by, value], hot, "left", limits, [out])


def share_at_or_below(points: DataFrame, point_value: str, curve: DataFrame, curve_value: str, out: str,
                      by: Sequence[str] = (), limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Where each point stands in another table's distribution: 100 × (curve values ≤ point) / n.

    Both tables' values are counted together, so the lookup is one running total, not a join of every
    point with every curve value.
    """
    c = curve.filter(F.col(curve_value).isNotNull()).groupBy(*by, F.col(curve_value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    p = points.filter(F.col(point_value).isNotNull()).select(*by, F.col(point_value).cast("double").alias("_v")).distinct()
    both = c.unionByName(p.withColumn("_c", F.lit(0).cast("long"))).groupBy(*by, "_v").agg(F.sum("_c").alias("_c"))
    ranged = _ranged(both, by, "_v", limits)
    placed = _totals(ranged, by, "_v", ["_c"])
    placed = placed.select(*by, "_v", F.when(
        F.col("_c_total") > 0, F.lit(100.0) * (F.col("_c_before") + F.col("_c")) / F.col("_c_total")).alias(out))
    valued = points.withColumn("_v", F.col(point_value).cast("double"))
    hot = valued.groupBy(*by, "_v").agg(F.count("*").alias("_n")).filter(F.col("_n") > limits.hot_rows)
    return salted_join(valued, placed, [*by, "_v"], hot, points.columns, "left", limits.salts).drop("_v")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str],
                    limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Exact quantiles per group, interpolated between neighbours; plus ``n``, the known count.

    Works from value counts and running totals, so no task holds a group's values.
    """
    ranks = value_ranks(df.select(*by, F.col(value).cast("double").alias("_v")), by, "_v", limits)
    aggs = [F.max("n").alias("n")]
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for end, pos in (("a", F.floor(at)), ("b", F.ceil(at))):
            holds = (F.col("below") <= pos) & (pos < F.col("below") + F.col("ties"))
            aggs.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{end}{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_f{i}"))
    out = ranks.groupBy(*by).agg(*aggs)
    return out.select(*by, "n", *[
        (F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(name)
        for i, name in enumerate(names)])


def median(df: DataFrame, by: Sequence[str], value: str, out: str = "median", limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    return exact_quantiles(df, by, value, [0.5], [out], limits)


def upper_median(df: DataFrame, by: Sequence[str], value: str, out: str = "median", limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The middle value, or the upper of the two middle ones."""
    ranks = value_ranks(df.select(*by, F.col(value).cast("double").alias("_v")), by, "_v", limits)
    pos = F.floor(F.col("n") / 2)
    holds = (F.col("below") <= pos) & (pos < F.col("below") + F.col("ties"))
    return ranks.groupBy(*by).agg(F.max(F.when(holds, F.col("_v"))).alias(out))


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str, out: str = "weighted_median",
                    limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The first value, in order, at which the running weight reaches half the group's weight."""
    kept = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    weights = kept.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.sum(F.col(weight).cast("double")).alias("_w"))
    totals = running_totals(weights, by, "_v", ["_w"], limits)
    reached = F.col("_w_before") + F.col("_w") >= F.col("_w_total") / 2
    return totals.filter(reached).groupBy(*by).agg(F.min("_v").alias(out))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, position: str = "position") -> DataFrame:
    """First ``k`` rows per group. Spark keeps only ``k`` rows per group and task before shuffling,
    so a huge group sends little."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).filter(F.col(position) <= k)


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    return top_k(df, by, order, 1, "_pos").drop("_pos")


def stretch(scores: DataFrame, score: str, order: Sequence[Column], n: int, min_span: float = 20.0,
            out: str = "relative") -> DataFrame:
    """The top ``n`` rows with scores stretched to 0–100, over a span of at least ``min_span``.

    ``n`` is a report length, so the window over the kept rows is small by definition.
    """
    top = scores.orderBy(*order).limit(n)
    best = top.agg(F.max(score).alias("_max"), F.min(score).alias("_min"))
    span = F.greatest(F.col("_max") - F.col("_min"), F.lit(float(min_span)))
    return (top.join(F.broadcast(best), F.lit(True), "left")
            .withColumn(out, 100 - (F.col("_max") - F.col(score)) / span * 100).drop("_max", "_min"))


def row_positions(df: DataFrame, by: Sequence[str], order: str, key: str, out: str = "position", descending: bool = False,
                  limits: Limits = DEFAULT_LIMITS, keep: Sequence[str] = ()) -> DataFrame:
    """1-based position of every row in its group, ordered by ``order`` and then by a unique ``key`` (a number or text).

    Positions come from counts of values, then from counts of keys inside ties: no window holds a group.
    Rows are read three times, so make an expensive input durable first. ``keep`` also returns ``n`` or other rank columns.
    """
    ranks, hot = _ranked(df, by, order, limits)
    rows = _join_ranks(df, ranks, [key], [*by, order], hot, "inner", limits, ["below", "ties", "n"])
    tied = rows.filter(F.col("ties") > 1).select(*by, order, key).withColumn("_one", F.lit(1).cast("long"))
    inside = running_totals(tied, [*by, order], key, ["_one"], limits).select(key, *by, F.col("_one_before").alias("_inside"))
    rows = rows.join(inside, [key, *by], "left")
    first = F.col("n") - F.col("below") - F.col("ties") if descending else F.col("below")
    rows = rows.withColumn(out, first + F.coalesce("_inside", F.lit(0)) + 1)
    return rows.drop("_inside", *[c for c in ("below", "ties", "n") if c not in keep])


def position_shade(df: DataFrame, key: str, by: Sequence[str], value: str, out: str = "shade",
                   limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """100 × (1 − position/(n−1)) by descending value, 100 for a lone row; ties follow the key."""
    placed = row_positions(df, by, value, key, "_pos", True, limits, keep=["n"])
    shade = F.when(F.col("n") > 1, 100 * (1 - (F.col("_pos") - 1) / (F.col("n") - 1))).otherwise(100.0)
    return placed.withColumn(out, shade).drop("_pos", "n")
