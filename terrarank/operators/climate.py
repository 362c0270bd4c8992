"""Monthly normals: yearly summaries, nested series, climate types and families.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import climate as K
from ..session import rows_table

SEASONS = {"summer": [6, 7, 8], "winter": [12, 1, 2], "spring": [3, 4, 5], "fall": [9, 10, 11], "year": list(range(1, 13))}


def season(months: Sequence[int], column: str, how: str, month: str = "month") -> Column:
    """Aggregate over some months; a sum, highest or lowest needs every one of them."""
    v = F.when(F.col(month).isin(*months), F.col(column))
    value = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[how](v)
    return value if how == "mean" else F.when(F.count(v) == len(months), value)


def summarize(monthly: DataFrame, key: str, measures: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """One row per place; ``measures``: output -> (season, column, how)."""
    return monthly.groupBy(key).agg(*[season(SEASONS[s], c, how).alias(out) for out, (s, c, how) in measures.items()])


def fill_mean_temperature(monthly: DataFrame, mean: str, high: str, low: str) -> DataFrame:
    return monthly.withColumn(mean, F.coalesce(mean, (F.col(high) + F.col(low)) / 2))


def _twelve(value: Column, month: str = "month") -> Column:
    return F.array(*[F.max(F.when(F.col(month) == m, value)) for m in range(1, 13)])


def series(monthly: DataFrame, key: str, columns: Sequence[str], digits: int = 1) -> DataFrame:
    """Twelve-month arrays, January first, values rounded, NULL where a month is unknown.

    One conditional aggregate per month, so a place with too many rows cannot grow an array.
    """
    return monthly.groupBy(key).agg(*[_twelve(F.bround(c, digits)).alias(c) for c in columns])


def types(monthly: DataFrame, key: str, high: str = "tmax_f", low: str = "tmin_f", rain: str = "precip_in") -> DataFrame:
    """``koppen`` and ``koppen_alt`` of the places with all twelve months known (°F and inches)."""
    rows = monthly.groupBy(key).agg(
        F.count("*").alias("_n"), _twelve(((F.col(high) + F.col(low)) / 2 - 32) * 5 / 9).alias("_t"), _twelve(F.col(rain) * 25.4).alias("_p"))
    known = lambda a: F.forall(a, lambda x: x.isNotNull())
    rows = rows.filter((F.col("_n") == 12) & known("_t") & known("_p"))
    base, alt = K.koppen_with_border(F.col("_t"), F.col("_p"))
    return rows.select(key, base.alias("koppen"), alt.alias("koppen_alt"))


def all_zero(array: Column | str) -> Column:
    """Effectively zero all year."""
    return F.forall(array, lambda v: v.isNull() | (v < 0.05))


def families(spark) -> DataFrame:
    return rows_table(spark, K.family_rows(), "koppen string, family string, position int, family_name string")


def describe_filter(accepts: DataFrame, present: DataFrame) -> DataFrame:
    """A climate accept list per search in words, by family: "not Desert or Tropical", "only …", "any".

    Works on the thirty types, so everything here is small.
    """
    spark = accepts.sparkSession
    codes = families(spark).join(present.select("koppen").distinct(), "koppen")
    searches = accepts.select("search", "accept")
    rows = searches.join(codes, F.lit(True)).withColumn("_ok", F.array_contains("accept", F.col("koppen")))
    fam = rows.groupBy("search", "family", "position", "family_name").agg(F.count_if("_ok").alias("_n"), F.count("*").alias("_of"))
    pack = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("position", "family_name")))),
                                    lambda x: x["family_name"])
    out = fam.groupBy("search").agg(
        pack(F.col("_n") == 0).alias("_out"), pack((F.col("_n") > 0) & (F.col("_n") < F.col("_of"))).alias("_part"),
        pack(F.col("_n") > 0).alias("_kept"), F.count("*").alias("_all"))
    def either(a: str) -> Column:
        n = F.size(a)
        return F.when(n <= 1, F.array_join(a, "")).otherwise(
            F.concat(F.array_join(F.slice(a, 1, n - 1), ", "), F.lit(" or "), F.element_at(a, -1)))
    no, part = F.size("_out"), F.size("_part")
    text = (F.when(no == F.col("_all"), "nothing allowed").when((no == 0) & (part == 0), "any")
            .when(no > F.col("_all") / 2, F.concat(F.lit("only "), either("_kept")))
            .when(no > 0, F.concat(F.lit("not "), either("_out"))).otherwise(F.concat(F.lit("not all of "), either("_part"))))
    return out.select("search", text.alias("text"))
