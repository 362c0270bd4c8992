"""Newest periods: of a long table, and of month columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_period(df: DataFrame, period: str) -> DataFrame:
    """Rows of the newest period.

    The first read takes the period's column alone; its one value is a literal filter of the second, which reaches the
    scan, so files, partitions and row groups of other periods are skipped.
    """
    newest = df.agg(F.max(period)).first()[0]
    return df.where(F.lit(False) if newest is None else F.col(period) == F.lit(newest))


def latest_month(wide: DataFrame, key: str, months: Sequence[str], out: str, known_share: float = 0.5) -> DataFrame:
    """Month columns (named ``yyyy-mm…``) to the latest month known for more than half the rows, and the
    change over the twelve months before it, in %.

    One long pass counts the known rows per month; the two months' values come from conditional maxima, so
    the table is never joined to itself.
    """
    long = wide.unpivot([key], list(months), "month", "value").withColumn("_m", F.to_date(F.substring("month", 1, 7), "yyyy-MM"))
    rows = wide.agg(F.count("*").alias("_rows"))
    counts = long.groupBy("_m").agg(F.count("value").alias("_known"))
    latest = counts.join(F.broadcast(rows), F.lit(True)).filter(F.col("_known") > known_share * F.col("_rows")).agg(F.max("_m").alias("_latest"))  # one row
    both = long.join(F.broadcast(latest), F.lit(True)).filter(F.col("_m").isin(F.col("_latest"), F.add_months("_latest", -12)))
    now = F.max(F.when(F.col("_m") == F.col("_latest"), F.col("value")))
    before = F.max(F.when(F.col("_m") != F.col("_latest"), F.col("value")))
    return both.groupBy(key).agg(now.alias(out), (100 * (now / F.when(before != 0, before) - 1)).alias(f"{out}_yoy"),
                                 F.date_format(F.max("_latest"), "yyyy-MM").alias("month"))
