"""Writing results: rounding, interim tables, partitioned publishing and its index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Audit columns the published table leaves out.
AUDIT_COLUMNS = ["aggregate_real_estate_taxes", "aggregate_home_value", "zhvi_county", "zillow_month", "home_value_today_source",
                 "new_buyer_sample", "nri_version"]


def compact(df: DataFrame, digits: Mapping[str, int], default: int = 3, drop: Sequence[str] = AUDIT_COLUMNS) -> DataFrame:
    """Audit columns dropped, numbers rounded (halves to even), whole-number columns as integers."""
    out = []
    for f in df.schema:
        if f.name in drop:
            continue
        if f.dataType.typeName() in ("double", "float"):
            d = digits.get(f.name, default)
            c = F.bround(F.when(~F.isnan(f.name), F.col(f.name)), d)
            out.append((c.cast("long") if d == 0 else c).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_interim(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_interim(spark: SparkSession, folder: str, name: str, keys: Sequence[str]) -> DataFrame:
    """An interim table; a key column that is not text means leading zeros are gone."""
    df = spark.read.parquet(f"{folder}/{name}")
    lost = [k for k in keys if k in df.columns and df.schema[k].dataType.typeName() != "string"]
    if lost:
        raise ValueError(f"{name}: key columns are not text: {', '.join(lost)}")
    return df


def publish(df: DataFrame, folder: str, partition: Sequence[str]) -> None:
    """Partitioned files. Rows are rebalanced by partition: small partitions share tasks, so files stay large, and one that
    holds most rows is spread over several tasks."""
    df.hint("rebalance", *[F.col(c) for c in partition]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(folder)


def index_of(df: DataFrame, partition: str, generated: str) -> DataFrame:
    """Row counts and build date per partition."""
    return df.groupBy(partition).agg(F.count("*").alias("rows"), F.lit(generated).alias("generated"))
