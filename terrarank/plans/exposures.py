"""Exposure over order lines: each line is a block with people (its quantity), its part the tract, its
supplier's nation the county."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exposure
from . import base
from .registry import query, r, rs, shared, with_

BLOCKS = """blocks AS (SELECT l_orderkey * 10 + l_linenumber AS block, l_partkey AS tract, s_nationkey::BIGINT AS county, l_quantity::BIGINT AS pop,
   CASE WHEN l_orderkey % 4 <> 0 AND l_partkey % 13 <> 0 THEN l_discount * 100 END AS value, l_suppkey AS supp,
   25 + (l_partkey * 37 % 2500) / 100.0::DOUBLE + (l_linenumber % 5) / 50.0::DOUBLE AS lat, -125 + (l_partkey * 91 % 5800) / 100.0::DOUBLE + (l_orderkey % 7) / 60.0::DOUBLE AS lon
   FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""


@shared
def blocks(t):
    li, k = t.lineitem, F.col("l_orderkey")
    p = F.col("l_partkey")
    return li.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(
        (k * 10 + F.col("l_linenumber")).alias("block"), p.alias("tract"), F.col("s_nationkey").cast("long").alias("county"),
        F.col("l_quantity").cast("long").alias("pop"), F.when((k % 4 != 0) & (p % 13 != 0), F.col("l_discount") * 100).alias("value"),
        F.col("l_suppkey").alias("supp"), (25 + (p * 37 % 2500) / 100.0 + (F.col("l_linenumber") % 5) / 50.0).alias("lat"),
        (-125 + (p * 91 % 5800) / 100.0 + (k % 7) / 60.0).alias("lon"))


def _exposure_sql(by: str) -> str:
    return f"""SELECT {by}, CASE WHEN cov >= 0.5 THEN w / kn END AS v, CASE WHEN cov >= 0.5 THEN mx END AS v_max, round_even(100 * cov, 1) AS v_coverage,
     CASE WHEN cov >= 0.5 THEN round_even(100 * ab / kn, 1) END AS v_above FROM (SELECT {by}, coalesce(sum(pop) FILTER (WHERE value IS NOT NULL), 0)::DOUBLE AS kn,
     coalesce(sum(pop) FILTER (WHERE value IS NOT NULL), 0) / sum(pop)::DOUBLE AS cov, sum(pop * value) AS w, max(value) AS mx,
     coalesce(sum(pop) FILTER (WHERE value > 5), 0)::DOUBLE AS ab FROM blocks GROUP BY {by})"""


@query("D4", with_(BLOCKS, select=f"SELECT tract, {rs('v')} AS exposure, {rs('v_max')} AS exposure_max, v_coverage::DOUBLE AS exposure_coverage, v_above::DOUBLE AS exposure_above FROM ({_exposure_sql('tract')})"))
def exposure_by_tract(t):
    e = exposure.weighted_exposure(blocks(t), ["tract"], "exposure", benchmark=5.0)
    return e.select("tract", r("exposure").alias("exposure"), r("exposure_max").alias("exposure_max"), "exposure_coverage", "exposure_above")


@query("D5", with_(BLOCKS, select="SELECT county, round_even(100 * sum(CASE WHEN value > 8 THEN pop ELSE 0 END) / sum(pop)::DOUBLE, 1) AS doubted FROM blocks GROUP BY 1"))
def exposed_share(t):
    return exposure.share_of_people(blocks(t), ["county"], F.col("value") > 8, "doubted")


@query("D6", with_(BLOCKS, f"tr AS ({_exposure_sql('tract, county')})", f"co AS ({_exposure_sql('county')})",
  select=f"""SELECT c.county, {rs('c.v')} AS exposure, w.tract AS exposure_worst_tract, {rs('w.v')} AS exposure_worst FROM co c LEFT JOIN (
    SELECT county, tract, v FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY round(v, 9) DESC, tract) AS k FROM tr WHERE v IS NOT NULL) WHERE k = 1) w USING (county)"""))
def worst_tract_by_county(t):
    tracts = exposure.weighted_exposure(blocks(t), ["tract", "county"], "exposure").withColumn("exposure", r("exposure", 9))
    counties = exposure.weighted_exposure(blocks(t), ["county"], "exposure")
    w = exposure.worst_within(tracts, counties, "tract", "county", "exposure")
    return w.select("county", r("exposure").alias("exposure"), "exposure_worst_tract", r("exposure_worst").alias("exposure_worst"))


@query("D7", with_(BLOCKS, """x AS (SELECT county, sum(pop * cos(radians(lat)) * cos(radians(lon))) AS x, sum(pop * cos(radians(lat)) * sin(radians(lon))) AS y, sum(pop * sin(radians(lat))) AS z FROM blocks GROUP BY 1)""",
  select=f"SELECT county, {rs('degrees(atan2(z, sqrt(x * x + y * y)))')} AS lat, {rs('degrees(atan2(y, x))')} AS lon FROM x"))
def population_centers(t):
    return exposure.sphere_centers(blocks(t), ["county"], "pop").select("county", r("lat").alias("lat"), r("lon").alias("lon"))


@query("D7 D49", with_(*base.PLACE_SQL, select=f"""SELECT county, sum(population)::DOUBLE AS population, {rs('sum(population * lat) / sum(population)')} AS lat,
  {rs('sum(population * lon) / sum(population)')} AS lon FROM places GROUP BY 1 HAVING sum(population) >= 80000"""))
def large_group_centers(t):
    c = exposure.planar_centers(base.places(t), ["county"], "population", 80000)
    return c.select("county", "population", r("lat").alias("lat"), r("lon").alias("lon"))


CELLS = """cells AS (SELECT i::INT AS i, j::INT AS j, CASE WHEN n % 11 = 0 THEN -999.9::DOUBLE ELSE v END AS value FROM (
   SELECT floor((lat - 25) / 0.5 + 0.5) AS i, floor((lon + 125) / 0.5 + 0.5) AS j, avg(orders) + 2 AS v, count(*) AS n FROM places GROUP BY ALL))"""


@shared
def cells(t):
    g = base.places(t).groupBy(F.floor((F.col("lat") - 25) / 0.5 + 0.5).cast("int").alias("i"),
                               F.floor((F.col("lon") + 125) / 0.5 + 0.5).cast("int").alias("j"))
    return g.agg((F.avg("orders") + 2).alias("v"), F.count("*").alias("n")).select(
        "i", "j", F.when(F.col("n") % 11 == 0, F.lit(-999.9)).otherwise(F.col("v")).alias("value"))


SAMPLED = "sampled AS (SELECT b.*, c.value AS model FROM blocks b LEFT JOIN (SELECT * FROM cells WHERE value > -900) c ON c.i = floor((lat - 25) / 0.5 + 0.5) AND c.j = floor((lon + 125) / 0.5 + 0.5))"


@query("C15", with_(*base.PLACE_SQL, BLOCKS, CELLS, SAMPLED, select=f"SELECT block, {rs('model')} AS model FROM sampled"))
def raster_values_at_blocks(t):
    return exposure.raster_sample(blocks(t), cells(t), 25, -125, 0.5, 0.5, "model").select("block", r("model").alias("model"))


@query("D50 C27", with_(*base.PLACE_SQL, BLOCKS, CELLS, SAMPLED, select=f"""SELECT county, {rs('m')} AS model, {rs('v')} AS value, doubt FROM (
   SELECT county, CASE WHEN coalesce(sum(pop) FILTER (WHERE model IS NOT NULL), 0) / sum(pop)::DOUBLE >= 0.5 THEN sum(pop * model) / sum(pop) FILTER (WHERE model IS NOT NULL) END AS m,
     CASE WHEN coalesce(sum(pop) FILTER (WHERE value IS NOT NULL), 0) / sum(pop)::DOUBLE >= 0.5 THEN sum(pop * value) / sum(pop) FILTER (WHERE value IS NOT NULL) END AS v,
     round_even(100 * sum(CASE WHEN value > model THEN pop ELSE 0 END) / sum(pop)::DOUBLE, 1) AS doubt FROM sampled GROUP BY 1)"""))
def composed_source(t):
    b = exposure.raster_sample(blocks(t), cells(t), 25, -125, 0.5, 0.5, "model")
    doubt = F.sum(F.when(F.col("value") > F.col("model"), F.col("pop")).otherwise(0))
    one = b.groupBy("county").agg(*exposure.exposure_columns("model", value="model"), *exposure.exposure_columns("measured"),
                                  F.bround(100 * doubt / F.sum("pop"), 1).alias("doubt"))
    return one.select("county", r("model").alias("model"), r("measured").alias("value"), "doubt")


@query("D35", with_(BLOCKS, """y AS (SELECT supp AS i, pop % 3 AS yr, CASE WHEN supp % 9 = 0 AND pop % 3 = 1 THEN -999.9::DOUBLE ELSE avg(coalesce(value, 4)) END AS value FROM blocks GROUP BY 1, 2)""",
  select=f"SELECT i, {rs('CASE WHEN count(*) FILTER (WHERE value > -900) >= 3 THEN avg(value) FILTER (WHERE value > -900) END')} AS value FROM y GROUP BY 1"))
def cell_mean_over_years(t):
    b = blocks(t)
    y = b.groupBy(F.col("supp").alias("i"), (F.col("pop") % 3).alias("yr")).agg(F.avg(F.coalesce("value", F.lit(4.0))).alias("v"))
    y = y.withColumn("value", F.when((F.col("i") % 9 == 0) & (F.col("yr") == 1), F.lit(-999.9)).otherwise(F.col("v")))
    return exposure.mean_over_years(y, 3, ["i"]).select("i", r("value").alias("value"))


MONTHLY = """mo AS (SELECT l_suppkey AS zip, l_returnflag AS label, month(l_shipdate) AS m, avg(l_discount) AS p FROM lineitem GROUP BY ALL)"""


@query("D32", with_(MONTHLY, """x AS (SELECT zip, CASE WHEN count(*) FILTER (WHERE label = 'R') = 12 THEN 100 * avg(p) FILTER (WHERE label = 'R') END AS above4,
  CASE WHEN count(*) FILTER (WHERE label = 'A') = 12 THEN 100 * avg(p) FILTER (WHERE label = 'A') END AS above2 FROM mo GROUP BY 1)""",
  select=f"SELECT zip, {rs('above4')} AS above4, {rs('above2')} AS above2 FROM x WHERE above4 IS NOT NULL OR above2 IS NOT NULL"))
def annual_from_twelve_months(t):
    mo = t.lineitem.groupBy(F.col("l_suppkey").alias("zip"), F.col("l_returnflag").alias("label"), F.month("l_shipdate").alias("m")).agg(
        F.avg("l_discount").alias("p"))
    a = exposure.annual_from_months(mo, "zip", "label", "p", {"R": "above4", "A": "above2"}, 100.0)
    return a.select("zip", r("above4").alias("above4"), r("above2").alias("above2"))


@query("D33", with_("""y AS (SELECT l_suppkey AS site, year(l_shipdate) AS y, avg(l_tax * 100) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)""",
  select="SELECT site, round(avg(v), 2) AS reading, count(*) AS years FROM y GROUP BY 1 HAVING count(*) >= 2"))
def monitor_site_means(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("site"), F.year("l_shipdate").alias("y"), (F.col("l_tax") * 100).alias("v"), "l_linestatus")
    return exposure.site_means(rows, "site", "y", "v", F.col("l_linestatus") == "F", "reading")


@query("D34", """WITH o AS (SELECT user_id AS cell, ts::DATE AS d, CASE WHEN value > 80 THEN 3 WHEN value > 40 THEN 2 ELSE 1 END AS lv FROM events),
  dm AS (SELECT cell, d, max(lv) AS l FROM o GROUP BY ALL), n AS (SELECT count(DISTINCT d) AS n FROM o)
  SELECT cell, round(count(*) FILTER (WHERE l >= 1) * 365.0::DOUBLE / max(n), 6) AS any_days, round(count(*) FILTER (WHERE l >= 2) * 365.0::DOUBLE / max(n), 6) AS thick_days FROM dm, n GROUP BY 1""")
def event_days_per_cell(t):
    v = F.col("value")
    o = t.events.select(F.col("user_id").alias("cell"), F.to_date("ts").alias("d"), F.when(v > 80, 3).when(v > 40, 2).otherwise(1).alias("lv"))
    e = exposure.event_days(o, ["cell"], "d", "lv", {"any_days": 1, "thick_days": 2}, o.select("d"))
    return e.select("cell", r("any_days").alias("any_days"), r("thick_days").alias("thick_days"))


@query("D36", """WITH a AS (SELECT l_suppkey AS k, year(l_shipdate)::BIGINT AS y, round(avg(l_tax), 6) AS v FROM lineitem GROUP BY ALL),
  g AS (SELECT y FROM a GROUP BY y HAVING count(DISTINCT k) >= 0.9 * (SELECT count(*) FROM supplier)) SELECT k, y, v FROM a WHERE y = (SELECT max(y) FROM g)""")
def latest_complete_year(t):
    a = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").cast("long").alias("y")).agg(r(F.avg("l_tax")).alias("v"))
    return exposure.latest_complete_period(a, "k", "y", t.supplier.select(F.col("s_suppkey").alias("k"))).select("k", "y", "v")


@query("D37", with_(BLOCKS, select=f"""SELECT tract, {rs('CASE WHEN sum(w) > 0 THEN sum(value * w) / sum(w) ELSE avg(value) END')} AS walk
  FROM (SELECT tract, value, CASE WHEN tract % 5 = 0 THEN 0 ELSE pop END AS w FROM blocks WHERE value IS NOT NULL) GROUP BY 1"""))
def weighted_mean_with_fallback(t):
    b = blocks(t).withColumn("w", F.when(F.col("tract") % 5 == 0, 0).otherwise(F.col("pop")))
    return exposure.weighted_mean_or_mean(b, ["tract"], "value", "w", "walk").select("tract", r("walk").alias("walk"))


@query("D30", "SELECT l_partkey // 10 AS tract, sum(l_quantity)::BIGINT AS jobs FROM lineitem GROUP BY 1")
def jobs_by_tract(t):
    return t.lineitem.groupBy(F.expr("l_partkey div 10").alias("tract")).agg(F.sum("l_quantity").cast("long").alias("jobs"))


XWALK = """xw AS (SELECT src, tgt, CASE WHEN tgt % 7 = 0 THEN 0 ELSE q END::DOUBLE AS land FROM (
  SELECT l_partkey AS src, l_suppkey AS tgt, sum(l_quantity) AS q FROM lineitem GROUP BY ALL))"""


def crosswalk(t):
    g = t.lineitem.groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("tgt")).agg(F.sum("l_quantity").alias("q"))
    return g.select("src", "tgt", F.when(F.col("tgt") % 7 == 0, 0.0).otherwise(F.col("q")).alias("land"))


@query("C17", with_(XWALK, select=f"""SELECT tgt, {rs('CASE WHEN sum(land) > 0 THEN sum(p_retailprice * land) / sum(land) ELSE avg(p_retailprice) END')} AS walk
  FROM xw JOIN part ON p_partkey = src WHERE src % 3 <> 0 GROUP BY 1"""))
def areal_interpolation(t):
    values = t.part.select(F.col("p_partkey").alias("src"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("walk"))
    return exposure.interpolate(crosswalk(t), values, "src", "tgt", "land", "walk").select("tgt", r("walk").alias("walk"))


@query("C16", with_(XWALK, select="SELECT src, tgt FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY land DESC, tgt) AS k FROM xw) WHERE k = 1"))
def largest_crosswalk_part(t):
    return exposure.largest_part(crosswalk(t), "src", "tgt", "land")


SITES = "st AS (SELECT l_suppkey AS site, avg(l_tax * 100) AS measured, avg(CASE WHEN l_suppkey % 6 <> 0 THEN l_discount * 90 END) AS model FROM lineitem GROUP BY 1)"


def sites(t):
    s = F.col("l_suppkey")
    return t.lineitem.groupBy(s.alias("site")).agg(F.avg(F.col("l_tax") * 100).alias("measured"),
                                                   F.avg(F.when(s % 6 != 0, F.col("l_discount") * 90)).alias("model"))


@query("D43 H14", with_(SITES, "d AS (SELECT *, model - measured AS d FROM st WHERE model IS NOT NULL)", select=f"""SELECT count(*) AS sites, {rs('avg(d)')} AS bias,
  {rs('sqrt(avg(d * d))')} AS rmse, {rs('avg(abs(d))')} AS mae, {rs('corr(model, measured)')} AS r, abs(avg(d)) <= 0.5 AND sqrt(avg(d * d)) <= 2.0 AS passes FROM d"""))
def model_fit_statistics(t):
    f = exposure.fit_statistics(sites(t), "model", "measured")
    return f.select("sites", *[r(c).alias(c) for c in ("bias", "rmse", "mae", "r")], "passes")


@query("C25 H14", with_(SITES, "pairs AS (SELECT s_suppkey AS hot, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS clean FROM supplier)",
  select="""SELECT hot, clean, round(h.measured - c.measured, 2) + 0.0 AS measured, round(h.model - c.model, 2) + 0.0 AS model,
  coalesce(sign(h.model - c.model) = sign(h.measured - c.measured) AND abs(h.model - c.model) >= 0.5 * abs(h.measured - c.measured), false) AS passes
  FROM pairs LEFT JOIN st h ON h.site = hot LEFT JOIN st c ON c.site = clean"""))
def contrast_pairs(t):
    n = t.supplier.count()
    pairs = t.supplier.select(F.col("s_suppkey").alias("hot"), ((F.col("s_suppkey") * 7 + 3) % n).alias("clean"))
    return exposure.contrast(sites(t), pairs, "site", "model", "measured")
