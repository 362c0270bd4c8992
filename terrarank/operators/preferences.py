"""Saved searches as rows, cleaned before use: unknown measures dropped, weights clamped, county stand-ins
moved to the area level, retired measures folded.

``weights(search, level, metric, weight, direction, min, max)``: one row per measure a search mentions; NULL
where it says nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import measures
from ..functions.points import clamp_weight
from ..session import rows_table

DIRECTIONS = ["higher", "lower", "middle"]


def normalize(searches: DataFrame, known_county: DataFrame, known_area: DataFrame, moved: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows (search, level, metric, weight, direction, min, max) ready to score.

    Every definition table has a few dozen rows; the searches may be any number. An area setting already
    there wins over a moved one; the largest folded weight counts, only where the whole is not set.
    """
    known = known_county.select("metric", F.lit("county").alias("level"), F.col("fixed").alias("_fixed")).unionByName(
        known_area.select("metric", F.lit("area").alias("level"), F.col("fixed").alias("_fixed")))
    s = searches.join(F.broadcast(known), ["metric", "level"])
    w = F.when(F.col("weight").isNotNull() & ~F.isnan("weight"), clamp_weight("weight"))
    s = s.withColumns({"weight": w, "direction": F.when(F.col("direction").isin(*DIRECTIONS), F.col("direction"))})
    m = moved.select("metric", F.lit("county").alias("level"), F.col("target").alias("_to"), F.col("keep_limit").alias("_keep"))
    s = s.join(F.broadcast(m), ["metric", "level"], "left")
    goes = F.col("_to").isNotNull()
    keeps = ~goes | F.col("_keep").isNotNull()
    s = s.select(
        "search", F.when(goes, "area").otherwise(F.col("level")).alias("level"), F.coalesce("_to", "metric").alias("metric"),
        F.when(goes, 1).otherwise(0).alias("_late"), "weight", "direction", F.when(keeps, F.col("min")).alias("min"),
        F.when(keeps, F.col("max")).alias("max"), "_fixed")
    # The first setting in (own, moved) order wins, weight, direction and limit each on its own.
    has_limit = F.col("min").isNotNull() | F.col("max").isNotNull()
    s = s.groupBy("search", "level", "metric").agg(
        F.min_by("weight", F.when(F.col("weight").isNotNull(), F.col("_late"))).alias("weight"),
        F.min_by("direction", F.when(F.col("direction").isNotNull(), F.col("_late"))).alias("direction"),
        F.min_by("min", F.when(has_limit, F.col("_late"))).alias("min"), F.min_by("max", F.when(has_limit, F.col("_late"))).alias("max"))
    f = folds.select("metric", F.lit("county").alias("level"), F.col("whole").alias("_whole"))
    marked = s.join(F.broadcast(f), ["metric", "level"], "left")
    extra = marked.filter(F.col("_whole").isNotNull() & (F.col("weight") > 0)).groupBy("search", F.col("_whole").alias("metric")).agg(
        F.max("weight").alias("_folded")).withColumn("level", F.lit("county"))
    not_offered, limit_only = measures.NOT_OFFERED, measures.LIMIT_ONLY
    county = F.col("level") == "county"
    kept = s.filter(~(county & F.col("metric").isin(*not_offered)))
    only = county & F.col("metric").isin(*limit_only)
    kept = kept.withColumns({"weight": F.when(~only, F.col("weight")), "direction": F.when(~only, F.col("direction"))})
    out = kept.join(extra, ["search", "level", "metric"], "full").withColumn("weight", F.coalesce("weight", "_folded")).drop("_folded")
    fixed = known.filter(F.col("_fixed").isNotNull())
    out = out.join(F.broadcast(fixed), ["metric", "level"], "left").withColumn("direction", F.when(F.col("_fixed").isNull(), F.col("direction")))
    said = F.coalesce("weight", "min", "max").isNotNull() | F.col("direction").isNotNull()
    return out.filter(said).select("search", "level", "metric", "weight", "direction", "min", "max")


def area_criteria(normalized: DataFrame, definitions: DataFrame, budgets: DataFrame) -> DataFrame:
    """Area criteria of each search with their order; a budget or a fixed direction overrides the asked one.

    ``budgets``: (search, tenure, budget): buying sets a home value budget, renting a rent budget.
    """
    b = budgets.select("search", F.when(F.col("tenure") == "buy", "median_home_value").when(F.col("tenure") == "rent", "median_gross_rent").alias("metric"),
                       F.when(F.col("budget") > 0, F.col("budget")).alias("budget")).filter(F.col("metric").isNotNull())
    rows = normalized.filter((F.col("level") == "area") & (F.col("weight") > 0)).join(F.broadcast(definitions), "metric").join(b, ["search", "metric"], "left")
    forced = F.col("budget").isNotNull() | F.col("fixed").isNotNull()
    direction = F.when(forced, F.col("default_direction")).otherwise(F.coalesce("direction", "default_direction"))
    return rows.select("search", "metric", "label", "weight", direction.alias("direction"), "budget", "position")


def definitions_for(spark) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return (measures.county_measures(spark), measures.area_measures(spark), measures.moved_to_areas(spark), measures.folds(spark))


def example_searches(spark, rows: list[tuple]) -> DataFrame:
    return rows_table(spark, rows, "search string, level string, metric string, weight double, direction string, min double, max double")
