"""Frames the queries share, each with the SQL part that builds the same rows.

Places are customers, counties nations, states regions. The tables hold no unknown values, so
unknowns are made by a key rule, the same here and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables, shared

SPEND = """spend AS (
  SELECT o_custkey, round(sum(o_totalprice), 2) AS spend, count(*) AS orders FROM orders GROUP BY o_custkey)"""

PLACES = """places AS (
  SELECT c_custkey AS place, c_nationkey::BIGINT AS county, n_regionkey::BIGINT AS state, c_mktsegment AS segment,
         CASE WHEN c_custkey % 5 = 0 THEN 'BUILDING' END AS alt_segment,
         CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance,
         CASE WHEN c_custkey % 11 <> 3 THEN spend END AS spend,
         coalesce(orders, 0) AS orders,
         (coalesce(orders, 0) * 137 + c_custkey % 50)::BIGINT AS population,
         (c_custkey * 31 % 100) * 0.6::DOUBLE AS group_quarters_share,
         25 + (c_custkey * 37 % 2500) / 100.0::DOUBLE AS lat,
         -125 + (c_custkey * 91 % 5800) / 100.0::DOUBLE AS lon
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN spend ON c_custkey = o_custkey)"""


@shared
def spend(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spend"), F.count("*").alias("orders"))


@shared
def places(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    joined = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(spend(t), k == F.col("o_custkey"), "left"))
    orders = F.coalesce("orders", F.lit(0).cast("long"))
    return joined.select(
        k.alias("place"), F.col("c_nationkey").cast("long").alias("county"), F.col("n_regionkey").cast("long").alias("state"),
        F.col("c_mktsegment").alias("segment"), F.when(k % 5 == 0, "BUILDING").alias("alt_segment"),
        F.when(k % 7 != 0, F.col("c_acctbal")).alias("balance"), F.when(k % 11 != 3, F.col("spend")).alias("spend"),
        orders.alias("orders"), (orders * 137 + k % 50).alias("population"),
        ((k * 31 % 100) * F.lit(0.6)).alias("group_quarters_share"),
        (25 + (k * 37 % 2500) / 100.0).alias("lat"), (-125 + (k * 91 % 5800) / 100.0).alias("lon"))


PLACE_SQL = (SPEND, PLACES)
