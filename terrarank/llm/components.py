"""Connected components of links by alternating stars (Kiveris et al., 2014), on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest one."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that has a link; ``links`` has two columns of ids. The component is its smallest id.

    Rounds end when the table of stars stays the same; each is written to the shared folder, and only its count and
    checksum come to the driver.
    """
    a, b = links.columns
    edges = durable(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        edges = durable(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    smallest = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(smallest)
