"""Values at many small weighted units (blocks) to the places that hold them.

Every function is one or two partial aggregations: a place holding a third of all blocks still shuffles
one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import half_even

# Fixed values.
MIN_COVERAGE = 0.5            # below this share of people with a value, a place is unknown
NO_DATA_BELOW = -900.0        # at or below this a raster cell holds no data
MIN_SITE_YEARS = 2
COMPLETE_SHARE = 0.9
DAYS_PER_YEAR = 365.0
BIAS_BAR, RMSE_BAR, CONTRAST_SHARE = 0.5, 2.0, 0.5


def exposure_columns(name: str, pop: str = "pop", value: str = "value", benchmark: float | None = None) -> list[Column]:
    """Aggregates of one measure: mean, highest, coverage and (with a benchmark) the share above it."""
    known = F.col(value).isNotNull()
    people = F.sum(F.when(known, F.col(pop)).otherwise(0))
    coverage = people / F.sum(pop)
    enough = coverage >= MIN_COVERAGE
    out = [
        F.when(enough, F.sum(F.when(known, F.col(pop) * F.col(value))) / people).alias(name),
        F.when(enough, F.max(value)).alias(f"{name}_max"),
        half_even(100 * coverage, 1).alias(f"{name}_coverage"),
    ]
    if benchmark is not None:
        above = F.sum(F.when(known & (F.col(value) > benchmark), F.col(pop)).otherwise(0))
        out.append(F.when(enough, half_even(100 * above / people, 1)).alias(f"{name}_above"))
    return out


def weighted_exposure(blocks: DataFrame, by: Sequence[str], name: str, pop: str = "pop", value: str = "value",
                      benchmark: float | None = None) -> DataFrame:
    return blocks.groupBy(*by).agg(*exposure_columns(name, pop, value, benchmark))


def share_of_people(blocks: DataFrame, by: Sequence[str], flag: Column, out: str, pop: str = "pop") -> DataFrame:
    """% of each place's people whose block is flagged."""
    return blocks.groupBy(*by).agg(
        half_even(100 * F.sum(F.when(flag, F.col(pop)).otherwise(0)) / F.sum(pop), 1).alias(out))


def worst_within(tracts: DataFrame, counties: DataFrame, tract: str, county: str, name: str) -> DataFrame:
    """Each county beside its worst tract: the one with the highest mean (ties: the lowest tract)."""
    worst = tracts.filter(F.col(name).isNotNull()).groupBy(county).agg(
        F.min(F.struct((-F.col(name)).alias("first"), F.col(tract).alias("t"), F.col(name).alias("v"))).alias("_w"))
    worst = worst.select(county, F.col("_w.t").alias(f"{name}_worst_{tract}"), F.col("_w.v").alias(f"{name}_worst"))
    return counties.join(worst, county, "left")


def sphere_centers(df: DataFrame, by: Sequence[str], weight: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Weighted center on the sphere: right across the antimeridian."""
    la, lo, w = F.radians(lat), F.radians(lon), F.col(weight).cast("double")
    sums = df.groupBy(*by).agg(F.sum(w * F.cos(la) * F.cos(lo)).alias("_x"), F.sum(w * F.cos(la) * F.sin(lo)).alias("_y"),
                               F.sum(w * F.sin(la)).alias("_z"))
    return sums.select(*by, F.degrees(F.atan2("_z", F.hypot("_x", "_y"))).alias(lat), F.degrees(F.atan2("_y", "_x")).alias(lon))


def planar_centers(df: DataFrame, by: Sequence[str], weight: str, least: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Weighted planar centroid of the groups whose weight reaches ``least``."""
    w = F.col(weight).cast("double")
    sums = df.filter(w.isNotNull()).groupBy(*by).agg(
        F.sum(w).alias("_w"), (F.sum(w * F.col(lat)) / F.sum(w)).alias(lat), (F.sum(w * F.col(lon)) / F.sum(w)).alias(lon))
    return sums.filter(F.col("_w") >= least).withColumnRenamed("_w", weight)


def raster_sample(points: DataFrame, cells: DataFrame, lat0: float, lon0: float, dlat: float, dlon: float, out: str,
                  lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The value of the cell a point falls in; NULL outside the raster or on a no-data cell.

    An equi-join on the computed cell, never a scan of the raster per point.
    """
    i = F.floor((F.col(lat) - lat0) / dlat + 0.5).cast("int")
    j = F.floor((F.col(lon) - lon0) / dlon + 0.5).cast("int")
    grid = cells.select("i", "j", F.when(F.col("value") > NO_DATA_BELOW, F.col("value")).alias(out))
    return points.withColumns({"i": i, "j": j}).join(grid, ["i", "j"], "left").drop("i", "j")


def mean_over_years(cells: DataFrame, years: int, by: Sequence[str] = ("i", "j"), value: str = "value") -> DataFrame:
    """Cell means over years; a cell unknown in any year is unknown."""
    v = F.when(F.col(value) > NO_DATA_BELOW, F.col(value))
    return cells.groupBy(*by).agg(F.when(F.count(v) >= years, F.avg(v)).alias(value))


def annual_from_months(monthly: DataFrame, key: str, measure: str, value: str, names: Mapping[str, str],
                       scale: float = 1.0) -> DataFrame:
    """The year as the mean of its 12 months, one column per measure; a missing month is unknown."""
    cols = []
    for label, out in names.items():
        mine = F.when(F.col(measure) == label, F.col(value))
        cols.append(F.when(F.count(mine) == 12, scale * F.avg(mine)).alias(out))
    return monthly.groupBy(key).agg(*cols).filter(F.coalesce(*names.values()).isNotNull())


def site_means(readings: DataFrame, site: str, year: str, value: str, complete: Column, out: str,
               min_years: int = MIN_SITE_YEARS) -> DataFrame:
    """Mean of a site's complete yearly means; sites with too few complete years are dropped."""
    yearly = readings.filter(complete).groupBy(site, year).agg(F.avg(value).alias("_v"))
    sites = yearly.groupBy(site).agg(F.round(F.avg("_v"), 2).alias(out), F.count("*").alias("years"))
    return sites.filter(F.col("years") >= min_years)


def event_days(observations: DataFrame, cell: Sequence[str], day: str, level: str, thresholds: Mapping[str, int],
               analyzed_days: DataFrame) -> DataFrame:
    """Days a year each cell reaches a level: the day's highest level, counted over the analyzed days
    and scaled to a year. ``analyzed_days`` is one row per analyzed day."""
    daily = observations.groupBy(*cell, day).agg(F.max(level).alias("_l"))
    counts = daily.groupBy(*cell).agg(*[F.count_if(F.col("_l") >= least).alias(f"_{name}") for name, least in thresholds.items()])
    days = analyzed_days.agg(F.count_distinct(day).alias("_days"))
    joined = counts.join(F.broadcast(days), F.lit(True))  # one row
    return joined.select(*cell, *[(F.col(f"_{n}") * DAYS_PER_YEAR / F.col("_days")).alias(n) for n in thresholds])


def latest_complete_period(df: DataFrame, key: str, period: str, keys: DataFrame, share: float = COMPLETE_SHARE) -> DataFrame:
    """Rows of the newest period that holds at least ``share`` of the keys."""
    counts = df.groupBy(period).agg(F.count_distinct(key).alias("_have"))
    total = keys.select(key).distinct().agg(F.count("*").alias("_all"))
    newest = counts.join(F.broadcast(total), F.lit(True)).filter(  # one row
        F.col("_have") >= share * F.col("_all")).agg(F.max(period).alias(period))
    return df.join(F.broadcast(newest), period, "left_semi")


def weighted_mean_or_mean(df: DataFrame, by: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Weighted mean; the plain mean where every weight is zero."""
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    kept = df.filter(F.col(value).isNotNull())
    return kept.groupBy(*by).agg(
        F.when(F.sum(w) > 0, F.sum(F.col(value) * w) / F.sum(w)).otherwise(F.avg(value)).alias(out))


def interpolate(crosswalk: DataFrame, values: DataFrame, source: str, target: str, land: str, value: str) -> DataFrame:
    """Land-weighted mean across a many-to-many crosswalk; unweighted where no part has land."""
    rows = crosswalk.join(values.filter(F.col(value).isNotNull()), source)
    return weighted_mean_or_mean(rows, [target], value, land, value)


def largest_part(crosswalk: DataFrame, target: str, part: str, land: str) -> DataFrame:
    """The part with the most land per target (ties: the lowest part)."""
    best = crosswalk.filter(F.col(part).isNotNull()).groupBy(target).agg(
        F.min(F.struct((-F.coalesce(F.col(land).cast("double"), F.lit(0.0))).alias("l"), F.col(part).alias("p"))).alias("_b"))
    return best.select(target, F.col("_b.p").alias(part))


def fit_statistics(df: DataFrame, model: str, measured: str) -> DataFrame:
    """Bias, RMSE, MAE and correlation of a model against measurements, and whether it passes the bars."""
    d = F.col(model) - F.col(measured)
    stats = df.filter(F.col(model).isNotNull() & F.col(measured).isNotNull()).agg(
        F.count("*").alias("sites"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
        F.corr(model, measured).alias("r"))
    return stats.withColumn("passes", (F.abs("bias") <= BIAS_BAR) & (F.col("rmse") <= RMSE_BAR))


def contrast(sites: DataFrame, pairs: DataFrame, site: str, model: str, measured: str) -> DataFrame:
    """Named pairs known to differ: the model's gap has the measured sign and at least half its size."""
    s = sites.select(F.col(site), F.col(model).alias("_m"), F.col(measured).alias("_o"))
    hot, clean = s.toDF("hot", "_hm", "_ho"), s.toDF("clean", "_cm", "_co")
    rows = pairs.join(hot, "hot", "left").join(clean, "clean", "left")
    gap, model_gap = F.col("_ho") - F.col("_co"), F.col("_hm") - F.col("_cm")
    ok = (F.signum(model_gap) == F.signum(gap)) & (F.abs(model_gap) >= CONTRAST_SHARE * F.abs(gap))
    return rows.select("hot", "clean", F.round(gap, 2).alias("measured"), F.round(model_gap, 2).alias("model"),
                       F.coalesce(ok, F.lit(False)).alias("passes"))
