"""Ranks and windows over places and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank
from ..session import Limits
from . import base
from .registry import query, r, rs, with_

LONG = """long AS (
  SELECT place, state, 'balance' AS metric, balance AS value FROM places WHERE balance IS NOT NULL
  UNION ALL SELECT place, state, 'spend', spend FROM places WHERE spend IS NOT NULL
  UNION ALL SELECT place, state, 'orders', orders::DOUBLE FROM places)"""


def _long(t):
    return rank.unpivot(base.places(t), ["place", "state"], ["balance", "spend", "orders"])


def _bounds_sql(by: str) -> str:
    return f"""bounds AS (SELECT *,
      CASE WHEN count(*) OVER ({by}) = 1 THEN 50.0::DOUBLE ELSE 100.0::DOUBLE * (rank() OVER ({by} ORDER BY value) - 1) / (count(*) OVER ({by}) - 1) END AS lo,
      CASE WHEN count(*) OVER ({by}) = 1 THEN 50.0::DOUBLE ELSE 100.0::DOUBLE * (count(*) OVER ({by} ORDER BY value RANGE UNBOUNDED PRECEDING) - 1) / (count(*) OVER ({by}) - 1) END AS hi
      FROM long)"""


@query("E1 E2", with_(*base.PLACE_SQL, LONG, _bounds_sql("PARTITION BY metric"),
       select=f"SELECT place, metric, value, {rs('lo')} AS lo, {rs('hi')} AS hi, {rs('(lo + hi) / 2')} AS mid FROM bounds"))
def percentile_bounds(t):
    ranked = rank.rank_rows(_long(t), ["place"], ["metric"])
    return ranked.select("place", "metric", "value", r("lo").alias("lo"), r("hi").alias("hi"), r("mid").alias("mid"))


@query("E2", with_(*base.PLACE_SQL, LONG, _bounds_sql("PARTITION BY metric, state"),
       select=f"SELECT place, state, metric, {rs('lo')} AS lo, {rs('hi')} AS hi FROM bounds"))
def percentile_bounds_by_state(t):
    ranked = rank.rank_rows(_long(t), ["place"], ["metric", "state"])
    return ranked.select("place", "state", "metric", r("lo").alias("lo"), r("hi").alias("hi"))


@query("E5", with_(*base.PLACE_SQL, select=f"SELECT place, state, {rs('CASE WHEN balance IS NOT NULL THEN 100.0::DOUBLE * (rank() OVER (PARTITION BY state, balance IS NULL ORDER BY balance) + (count(*) OVER (PARTITION BY state, balance) - 1) / 2) / count(balance) OVER (PARTITION BY state) END')} AS pctl FROM places"))
def average_rank_percentiles(t):
    out = rank.average_rank_percentile(base.places(t), ["place"], ["state"], "balance", "pctl")
    return out.select("place", "state", r("pctl").alias("pctl"))


@query("E6", with_(*base.PLACE_SQL, select="SELECT place, county, CASE WHEN balance IS NOT NULL THEN rank() OVER (PARTITION BY county, balance IS NULL ORDER BY balance DESC) END AS rank, CASE WHEN balance IS NOT NULL THEN count(balance) OVER (PARTITION BY county) END AS group_count FROM places"))
def ranks_within_group(t):
    return rank.group_rank(base.places(t), ["place"], ["county"], "balance").select("place", "county", "rank", "group_count")


@query("E9", with_(*base.PLACE_SQL, select="SELECT place, row_number() OVER (ORDER BY orders DESC, place) AS position FROM places"))
def positions_overall(t):
    return rank.row_positions(base.places(t).select("place", "orders"), [], "orders", "place", descending=True).select("place", "position")


SPLIT = Limits(hot_rows=20, salts=4, slices=16)   # as if every group were large and many values were shared


@query("E1 E2", with_(*base.PLACE_SQL, LONG, _bounds_sql("PARTITION BY metric"),
       select=f"SELECT place, metric, value, {rs('lo')} AS lo, {rs('hi')} AS hi, {rs('(lo + hi) / 2')} AS mid FROM bounds"))
def ranks_on_split_groups(t):
    """Percentile bounds with groups cut into sixteen ranges and shared values salted."""
    ranked = rank.rank_rows(_long(t), ["place"], ["metric"], limits=SPLIT)
    return ranked.select("place", "metric", "value", r("lo").alias("lo"), r("hi").alias("hi"), r("mid").alias("mid"))


@query("E9 E10", with_(*base.PLACE_SQL, """kp AS (SELECT lpad(place::VARCHAR, 8, '0') AS place, lpad(county::VARCHAR, 5, '0') AS county, segment FROM places)""",
       select="""SELECT place, row_number() OVER (PARTITION BY county ORDER BY segment, place) AS position FROM kp"""))
def positions_on_text_keys(t):
    """Positions by a text column, ties by zero-padded text keys, in ranges and with salts."""
    keyed = base.places(t).select(F.lpad(F.col("place").cast("string"), 8, "0").alias("place"), F.lpad(F.col("county").cast("string"), 5, "0").alias("county"), "segment")
    return rank.row_positions(keyed, ["county"], "segment", "place", limits=SPLIT).select("place", "position")


PREP = """hs AS (SELECT p_partkey AS school, 100 + p_size * 10 AS enr, CASE WHEN p_partkey % 5 = 0 THEN -9 ELSE p_size END AS m, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 3 = 0 THEN -9 ELSE p_size % 7 END AS f, p_partkey % 20 AS courses FROM part),
  sh AS (SELECT school, courses, CASE WHEN m >= 0 OR f >= 0 THEN least(100, 100 * (greatest(m, 0) + greatest(f, 0)) / enr::DOUBLE) END AS share FROM hs),
  ok AS (SELECT *, (rank() OVER (ORDER BY share) + (count(*) OVER (PARTITION BY share) - 1) / 2) / count(*) OVER () AS a, (rank() OVER (ORDER BY courses) + (count(*) OVER (PARTITION BY courses) - 1) / 2) / count(*) OVER () AS b FROM sh WHERE share IS NOT NULL),
  sc AS (SELECT school, round((a + b) * 50, 9) AS score FROM ok)"""


@query("D46 E5", with_(PREP, select=f"SELECT school, {rs('score')} AS score, {rs('100.0::DOUBLE * (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER ()')} AS pctl FROM sc"))
def college_prep_scores(t):
    from ..operators import schools

    k, s = F.col("p_partkey"), F.col("p_size")
    hs = t.part.select(k.alias("school"), (100 + s * 10).alias("enrollment"), F.when(k % 5 == 0, -9).otherwise(s).alias("ap_M"),
                       F.when((k % 5 == 0) | (k % 3 == 0), -9).otherwise(s % 7).alias("ap_F"), F.lit(-9).alias("ap_X"), (k % 20).alias("courses"))
    out = schools.access_scores(hs, "school", ["ap_M", "ap_F", "ap_X"], "enrollment", "courses")
    return out.select("school", r("score").alias("score"), r("pctl").alias("pctl"))
