"""Area-level searches: customers as areas, nations as their counties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.flags import read_flags
from ..operators import area, rank, score
from . import base
from ..session import broadcast_checked, durable
from .registry import query, r, rs, rt, rts, shared, with_

MEASURES = ["spend", "orders", "pm25", "median_home_value"]
ESTIMATES = {"spend": "spend_eb"}

# search, metric, weight, direction, budget, position
CRITERIA = [
    ("a", "spend", 4.0, "higher", None, 0), ("a", "pm25", 3.0, "lower", None, 1),
    ("a", "median_home_value", 2.0, "lower", 180000.0, 2), ("a", "orders", 1.0, "middle", None, 3),
    ("b", "median_home_value", 5.0, "lower", None, 0), ("b", "orders", 2.0, "higher", None, 1),
]
LIMITS = [("a", "orders", 5.0, None), ("b", "pm25", None, 12.0), ("b", "spend", 100000.0, None)]
COUNTY_CRITERIA = [("a", "supplier_balance", 2.0, "higher"), ("b", "supplier_balance", 1.0, "lower")]
# metric, level, label, unit, default direction, helps, hurts, badge, top badge
DEFINITIONS = [
    ("spend", "area", "Yearly spend (all)", "$", "higher", "high spend", "low spend", "Biggest spenders", "Top 1% spend"),
    ("orders", "area", "Orders", "orders", "lower", None, None, None, None),
    ("pm25", "area", "Fine particles (PM2.5)", "µg/m³", "lower", "clean air", "more fine-particle pollution", "Cleanest air", None),
    ("median_home_value", "area", "Home value", "$", "lower", "cheap homes", "pricey homes", "Cheapest homes", "Top 1% cheapest"),
    ("supplier_balance", "county", "Distance to suppliers (mean)", "mi", "lower", None, None, None, None),
]

AREAS_SQL = """areas AS (SELECT place AS area, county, state, population, group_quarters_share, lat, lon, spend, orders,
  CASE WHEN place % 3 <> 0 THEN spend * 0.9::DOUBLE END AS spend_eb, 4 + (place % 97) / 10.0::DOUBLE AS pm25,
  100000 + balance * 20 AS median_home_value,
  concat_ws(';', CASE WHEN place % 13 = 0 THEN 'spend' END, CASE WHEN place % 17 = 0 THEN 'pm25' END,
    CASE WHEN place % 19 = 0 THEN 'mobile_homes' END) AS low_confidence,
  (population >= 51 AND group_quarters_share < 50) AS residential FROM places)"""
AREA_CRITERIA_SQL = """criteria AS (SELECT search, metric, weight::DOUBLE AS weight, direction, budget::DOUBLE AS budget, position FROM (VALUES
  ('a','spend',4,'higher',NULL,0), ('a','pm25',3,'lower',NULL,1), ('a','median_home_value',2,'lower',180000,2), ('a','orders',1,'middle',NULL,3),
  ('b','median_home_value',5,'lower',NULL,0), ('b','orders',2,'higher',NULL,1)) v(search, metric, weight, direction, budget, position))"""
AREA_LONG = """alng AS (
  SELECT area, 'spend' AS metric, spend AS shown, CASE WHEN spend IS NOT NULL AND spend_eb IS NOT NULL THEN spend_eb ELSE spend END AS value, low_confidence FROM areas WHERE residential
  UNION ALL SELECT area, 'orders', orders::DOUBLE, orders::DOUBLE, low_confidence FROM areas WHERE residential
  UNION ALL SELECT area, 'pm25', pm25, pm25, low_confidence FROM areas WHERE residential
  UNION ALL SELECT area, 'median_home_value', median_home_value, median_home_value, low_confidence FROM areas WHERE residential)"""
AREA_BOUNDS = """abounds AS (SELECT *,
   100.0::DOUBLE * (rank() OVER (PARTITION BY metric ORDER BY value) - 1) / (count(*) OVER (PARTITION BY metric) - 1) AS lo,
   100.0::DOUBLE * (count(*) OVER (PARTITION BY metric ORDER BY value RANGE UNBOUNDED PRECEDING) - 1) / (count(*) OVER (PARTITION BY metric) - 1) AS hi
   FROM alng WHERE value IS NOT NULL)"""


def cdf_sql(edge: float) -> str:
    z = f"(({edge} - value) / 1.7::DOUBLE)"
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * {x}))"
    erf = (f"(1 - ((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} "
           f"+ 0.254829592::DOUBLE) * {t} * exp(-{x} * {x}))")
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END)"


PM25_SQL = f"(25 * {cdf_sql(5)} + 25 * {cdf_sql(7)} + 25 * {cdf_sql(9)} + 25 * {cdf_sql(12)})"
AREA_PARTS = f"""aparts AS (SELECT search, area, b.metric, c.direction, weight, position, budget, shown, value, (lo + hi) / 2 AS percentile,
   CASE WHEN budget > 0 THEN CASE WHEN value <= budget THEN 100.0::DOUBLE ELSE greatest(0.0, 100 * (1.5 * budget - value) / (0.5 * budget)) END
        WHEN b.metric = 'pm25' THEN CASE WHEN low_confidence LIKE '%pm25%' THEN least({PM25_SQL}, 50) ELSE {PM25_SQL} END
        WHEN c.direction = 'higher' THEN hi WHEN c.direction = 'lower' THEN 100 - lo ELSE 100 - 2 * abs((lo + hi) / 2 - 50) END AS points,
   CASE WHEN budget > 0 OR b.metric = 'pm25' THEN NULL WHEN c.direction = 'higher' THEN lo WHEN c.direction = 'lower' THEN 100 - hi END AS beats,
   ((b.metric IN ('spend', 'pm25') AND list_contains(string_split(low_confidence, ';'), b.metric))
     OR (b.metric = 'median_home_value' AND list_contains(string_split(low_confidence, ';'), 'mobile_homes'))) AND shown IS NOT NULL AS flagged,
   CASE WHEN value <> shown AND abs(value - shown) >= 0.05 * abs(shown) THEN value END AS scored
   FROM abounds b JOIN criteria c USING (metric))"""
COUNTY_SIDE = """nb AS (SELECT n_nationkey::BIGINT AS county, round(avg(s_acctbal), 6) AS supplier_balance FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1),
nr AS (SELECT *, CASE WHEN supplier_balance IS NOT NULL THEN 100.0::DOUBLE * (rank() OVER (PARTITION BY supplier_balance IS NULL ORDER BY supplier_balance) - 1) / (count(supplier_balance) OVER () - 1) END AS lo,
  CASE WHEN supplier_balance IS NOT NULL THEN 100.0::DOUBLE * (count(*) OVER (PARTITION BY supplier_balance IS NULL ORDER BY supplier_balance RANGE UNBOUNDED PRECEDING) - 1) / (count(supplier_balance) OVER () - 1) END AS hi FROM nb),
cside AS (SELECT 'a' AS search, county, CASE WHEN supplier_balance IS NULL THEN 1 WHEN supplier_balance < 3000 THEN 2 ELSE 0 END AS county_status,
    2 * coalesce(hi, 50) AS county_sum, 2.0::DOUBLE AS county_weight, 'higher' AS direction, supplier_balance, lo, hi FROM nr
  UNION ALL SELECT 'b', county, 0, coalesce(100 - lo, 50), 1.0, 'lower', supplier_balance, lo, hi FROM nr)"""
AREA_SCORED = """ascored AS (SELECT x.search, x.area, x.county, population, status, lat, lon, state,
    CASE WHEN status < 2 THEN (county_sum + coalesce(sw, 0) + 50 * (tot - coalesce(w, 0))) / (county_weight + tot) END AS score FROM (
  SELECT s.search, a.area, a.county, population, lat, lon, state, county_sum, county_weight, CASE WHEN NOT residential THEN 3 WHEN county_status = 2 THEN 2
    WHEN s.search = 'a' AND orders < 5 THEN 2 WHEN s.search = 'b' AND (pm25 > 12 OR spend < 100000) THEN 2
    WHEN county_status = 1 OR (s.search = 'b' AND spend IS NULL) THEN 1 ELSE 0 END AS status
  FROM areas a JOIN cside s USING (county)) x
  JOIN (SELECT search, sum(weight) AS tot FROM criteria GROUP BY 1) USING (search)
  LEFT JOIN (SELECT search, area, sum(weight * points) AS sw, sum(weight) AS w FROM aparts GROUP BY ALL) p ON p.search = x.search AND p.area = x.area)"""
TOP = """atop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search ORDER BY status, round(coalesce(score, -1), 9) DESC, population DESC, area) AS position
  FROM ascored WHERE status < 2) WHERE position <= 100)"""
AREA_SQL = (*base.PLACE_SQL, AREAS_SQL, AREA_CRITERIA_SQL, AREA_LONG, AREA_BOUNDS, AREA_PARTS, COUNTY_SIDE, AREA_SCORED, TOP)


@shared
def areas(t):
    p = base.places(t)
    k = F.col("place")
    flags = F.concat_ws(";", F.when(k % 13 == 0, "spend"), F.when(k % 17 == 0, "pm25"), F.when(k % 19 == 0, "mobile_homes"))
    return p.select(
        k.alias("area"), "county", "state", "population", "group_quarters_share", "lat", "lon", "spend", "orders",
        F.when(k % 3 != 0, F.col("spend") * 0.9).alias("spend_eb"), (4 + (k % 97) / 10.0).alias("pm25"),
        (100000 + F.col("balance") * 20).alias("median_home_value"), read_flags(flags).alias("low_confidence"))


def criteria(t):
    return t.rows(CRITERIA, "search string, metric string, weight double, direction string, budget double, position int")


def limits(t):
    return t.rows(LIMITS, "search string, metric string, min double, max double")


def definitions(t):
    return t.rows(DEFINITIONS, "metric string, level string, label string, unit string, default_direction string, good string, "
                               "bad string, badge string, top_badge string")


@shared
def parts(t):
    return area.area_parts(areas(t), "area", criteria(t), MEASURES, ESTIMATES)


def counties(t):
    avg = t.supplier.groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 6).alias("supplier_balance"))
    return t.nation.join(avg, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        F.col("n_nationkey").cast("long").alias("county"), "supplier_balance")


@shared
def county_known(t):
    asked = t.rows(COUNTY_CRITERIA, "search string, metric string, weight double, direction string")
    return score.contributions(counties(t), "county", asked, ["supplier_balance"])


def county_side(t):
    asked = t.rows(COUNTY_CRITERIA, "search string, metric string, weight double, direction string")
    must = t.rows([("a", "supplier_balance", 3000.0, None), ("b", "supplier_balance", None, None)],
                  "search string, metric string, min double, max double")
    must_b = score.all_match(counties(t), "county", asked.filter("search = 'b'"))
    must_a = score.filter_results(counties(t), "county", must.filter("search = 'a'"))
    statuses = must_a.unionByName(must_b)
    return area.county_parts(statuses, "county", asked, county_known(t))


@shared
def scored(t):
    return area.score_areas(areas(t), "area", "county", criteria(t), limits(t), parts(t), county_side(t), MEASURES)


def top(t, n=100):
    s = scored(t).withColumn("exact", F.col("score")).withColumn("score", r("score", 9))
    return area.top_areas(s, "area", n)


@query("F7 F8 F9 F10 F11 F16 B14", with_(*AREA_SQL, select=f"""SELECT search, area, metric, {rs('shown')} AS value, {rs('percentile')} AS percentile,
  {rs('points')} AS points, {rs('weight * (points - 50)')} AS impact, {rs('beats')} AS beats, flagged, {rs('scored')} AS scored FROM aparts"""))
def area_part_points(t):
    p = parts(t)
    return p.select("search", "area", "metric", *[r(c).alias(c) for c in ("value", "percentile", "points", "impact", "beats")],
                    "flagged", r("scored").alias("scored"))


@query("C4", with_(*AREA_SQL, select=f"""SELECT search, county, county_status::BIGINT AS county_status, {rts('county_sum')} AS county_sum,
  county_weight FROM cside"""))
def county_shared_parts(t):
    return county_side(t).select("search", "county", F.col("county_status").cast("long"), rt("county_sum").alias("county_sum"), "county_weight")


@query("F12 B23", with_(*AREA_SQL, select=f"SELECT search, area, county, status::BIGINT AS status, {rts('score')} AS score FROM ascored"))
def area_scores(t):
    return scored(t).select("search", "area", "county", F.col("status").cast("long"), rt("score").alias("score"))


@query("F13", with_(*AREA_SQL, select=f"SELECT search, area, status::BIGINT AS status, {rts('score')} AS score, position FROM atop"))
def area_results(t):
    return top(t).select("search", "area", F.col("status").cast("long"), rt("exact").alias("score"), F.col("position").cast("long"))


@query("F14", with_(*AREA_SQL, select=f"SELECT search, area, county, {rts('score')} AS score FROM ascored WHERE status < 2 AND county IN (3, 7)"))
def area_matches_in_counties(t):
    members = t.rows([(3,), (7,)], "county long")
    return area.matches_within(scored(t), "area", members, "county").select("search", "area", "county", rt("score").alias("score"))


@query("F15", with_(*AREA_SQL, select=f"""SELECT search, county, {rts('max(score)')} AS best_score, count(*) AS areas,
  string_agg(area::VARCHAR, ',' ORDER BY position) AS members FROM atop GROUP BY search, county"""))
def area_results_by_county(t):
    c = area.by_county(top(t), "county", "area")
    return c.select("search", "county", rt("best_score").alias("best_score"), "areas",
                    F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("D47", with_(*AREA_SQL, "lv AS (SELECT *, state::VARCHAR AS g1, state || '/' || county AS g2, state || '/' || county || '/' || area AS g3 FROM atop)",
  select=" UNION ALL ".join(f"""SELECT search, '{lv}' AS level, {g} AS "group", count(*) AS results, {rs('avg(lat)')} AS lat, {rs('avg(lon)')} AS lon,
   {rs('min(lat)')} AS south, {rs('max(lat)')} AS north, {rs('min(lon)')} AS west, {rs('max(lon)')} AS east FROM lv GROUP BY ALL"""
   for lv, g in (("state", "g1"), ("county", "g2"), ("area", "g3")))))
def area_results_rollup(t):
    places = areas(t).select("area", "state", "lat", "lon")
    rolled = area.rollup_results(top(t).join(places, "area"), ["state", "county", "area"])
    return rolled.select("search", "level", "group", "results", *[r(c).alias(c) for c in ("lat", "lon", "south", "north", "west", "east")])


@query("E11 F25", with_(*AREA_SQL, select="""SELECT x.search, x.area, count(*) FILTER (WHERE
   (y.status, -round(coalesce(y.score, -1), 9), -y.population, y.area) < (x.status, -round(coalesce(x.score, -1), 9), -x.population, x.area)) + 1 AS rank,
   count(*) AS "of" FROM ascored x JOIN ascored y ON x.search = y.search AND y.status < 2
   WHERE x.status < 2 AND x.area IN (10, 200, 333, 1000, 1499) GROUP BY ALL"""))
def area_national_rank(t):
    s = scored(t).withColumn("score", r("score", 9))
    return area.rank_among_all(s, "area", t.rows([(10,), (200,), (333,), (1000,), (1499,)], "area long")).select("search", "area", "rank", "of")


@query("F17", with_(*AREA_SQL, select="""SELECT search, area, metric, CASE WHEN v IS NULL THEN 'unknown' WHEN v < lo OR v > hi THEN 'fail' ELSE 'pass' END AS state FROM (
   SELECT 'a' AS search, area, 'orders' AS metric, orders::DOUBLE AS v, 5 AS lo, 1e300 AS hi FROM areas
   UNION ALL SELECT 'b', area, 'pm25', pm25, -1e300, 12 FROM areas UNION ALL SELECT 'b', area, 'spend', spend, 100000, 1e300 FROM areas)"""))
def area_limit_results(t):
    return area.limit_results(areas(t), "area", limits(t), MEASURES).select("search", "area", "metric", "state")


@query("E8", with_(*AREA_SQL, "ct AS (SELECT * FROM atop WHERE search = 'a' AND position <= 50)",
  select=f"SELECT area, {rts('100 - (m.hi - score) / greatest(m.hi - m.lo, 20) * 100')} AS relative FROM ct, (SELECT max(score) AS hi, min(score) AS lo FROM ct) m"))
def area_relative_scores(t):
    mine = top(t).filter("search = 'a'").withColumn("score", F.col("exact"))
    return rank.stretch(mine, "score", [F.asc("position")], 50).select("area", rt("relative").alias("relative"))


@query("E9", with_(*AREA_SQL, select=f"""SELECT search, county, area, {rs('CASE WHEN n > 1 THEN 100 * (1 - (p - 1)::DOUBLE / (n - 1)) ELSE 100 END')} AS shade FROM (
   SELECT search, county, area, row_number() OVER (PARTITION BY search, county ORDER BY round(score, 9) DESC, area) AS p,
     count(*) OVER (PARTITION BY search, county) AS n FROM ascored WHERE status < 2)"""))
def area_shade_by_position(t):
    s = durable(scored(t).filter(score.shown("status")).withColumn("score", r("score", 9)))
    return rank.position_shade(s, "area", ["search", "county"], "score").select(
        "search", "county", "area", r("shade").alias("shade"))


BADGE_SQL = """defs AS (SELECT * FROM (VALUES ('spend','Yearly spend (all)','higher','Biggest spenders','Top 1% spend'), ('orders','Orders','lower',NULL,NULL),
   ('pm25','Fine particles (PM2.5)','lower','Cleanest air',NULL), ('median_home_value','Home value','lower','Cheapest homes','Top 1% cheapest'))
   v(metric, label, dflt, badge, top_badge)),
tp AS (SELECT p.*, coalesce(CASE WHEN p.direction = dflt THEN badge END, 'Best for ' || lower(label)) AS name, CASE WHEN p.direction = dflt THEN top_badge END AS gold
   FROM aparts p JOIN atop t ON p.search = t.search AND p.area = t.area JOIN areas a ON a.area = p.area JOIN defs d ON d.metric = p.metric
   WHERE p.budget IS NULL AND NOT (p.metric = 'median_home_value' AND a.low_confidence LIKE '%mobile_homes%')),
pk AS (SELECT *, max(points) OVER (PARTITION BY search, metric) AS peak FROM tp),
pt AS (SELECT *, sum(CASE WHEN points = peak THEN 1 ELSE 0 END) OVER (PARTITION BY search, metric) AS at_peak FROM pk)"""


@query("E12", with_(*AREA_SQL, BADGE_SQL, select="""SELECT search, area, coalesce(array_to_string((list(name ORDER BY position) FILTER (WHERE points = peak AND at_peak = 1))[1:2], ';'), '') AS best,
   arg_min(gold, position) FILTER (WHERE gold IS NOT NULL AND beats >= 99) AS top1 FROM pt GROUP BY ALL"""))
def area_badges(t):
    listed = top(t).select("search", "area")
    flags = areas(t).select("area", "low_confidence")
    rows = parts(t).join(broadcast_checked(durable(listed)), ["search", "area"], "left_semi").join(flags, "area")
    b = area.badges(rows, "area", definitions(t), F.array_contains("low_confidence", "mobile_homes"))
    return b.select("search", "area", F.array_join("best", ";").alias("best"), "top1")


@query("F6", with_(*AREA_SQL, select="""SELECT s.search, area, metric, floor(lo)::BIGINT AS figure FROM abounds, (SELECT DISTINCT search FROM criteria) s
   WHERE lo >= 95 AND metric IN ('pm25', 'spend', 'median_home_value') AND NOT EXISTS (SELECT 1 FROM criteria c WHERE c.search = s.search AND c.metric = abounds.metric)
   UNION ALL SELECT s.search, area, 'radon', floor(area % 50 + 0.5)::BIGINT FROM areas, (SELECT DISTINCT search FROM criteria) s WHERE area % 50 >= 40"""))
def area_watch_outs(t):
    a = areas(t).withColumn("radon", (F.col("area") % 50).cast("double"))
    return area.cautions(a, "area", ["pm25", "spend", "median_home_value"], criteria(t), MEASURES, ESTIMATES, radon="radon")


# Display text of the trade-off sentence: unit (or "budget" and measure), direction, whether it helps, words.
WORDINGS = [
    ("budget", "", "good", "homes within your budget"), ("budget", "", "bad", "prices over your budget"),
    ("budget", "median_gross_rent", "good", "rent within your budget"),
    ("", "higher", "good", "high {name}"), ("", "higher", "bad", "low {name}"), ("", "lower", "good", "low {name}"), ("", "lower", "bad", "high {name}"),
    ("", "middle", "good", "typical {name}"), ("", "middle", "bad", "unusual {name}"),
    ("mi", "higher", "good", "the distance to {place}"), ("mi", "higher", "bad", "{place} close by"),
    ("mi", "lower", "good", "{place} nearby"), ("mi", "lower", "bad", "the distance to {place}"),
    ("pctl", "higher", "good", "high risk of {name}"), ("pctl", "higher", "bad", "low risk of {name}"),
    ("pctl", "lower", "good", "low risk of {name}"), ("pctl", "lower", "bad", "high risk of {name}"),
    ("days", "higher", "good", "many {name}"), ("days", "higher", "bad", "few {name}"), ("days", "lower", "good", "few {name}"), ("days", "lower", "bad", "many {name}"),
    ("nights", "higher", "good", "many {name}"), ("nights", "higher", "bad", "few {name}"), ("nights", "lower", "good", "few {name}"), ("nights", "lower", "bad", "many {name}"),
]


ALL_PARTS = """allp AS (SELECT search, area, metric, 'area' AS level, direction, weight * (points - 50) AS impact, budget FROM aparts
  UNION ALL SELECT s.search, a.area, 'supplier_balance', 'county', s.direction, CASE s.search WHEN 'a' THEN 2 * (hi - 50) ELSE 100 - lo - 50 END, NULL
  FROM areas a JOIN cside s USING (county) WHERE supplier_balance IS NOT NULL AND residential),
worded AS (SELECT *, CASE metric WHEN 'spend' THEN CASE WHEN impact > 0 THEN 'high spend' ELSE 'low spend' END
  WHEN 'pm25' THEN CASE WHEN impact > 0 THEN 'clean air' ELSE 'more fine-particle pollution' END
  WHEN 'median_home_value' THEN CASE WHEN budget > 0 THEN CASE WHEN impact > 0 THEN 'homes within your budget' ELSE 'prices over your budget' END
     WHEN impact > 0 THEN 'cheap homes' ELSE 'pricey homes' END
  WHEN 'orders' THEN CASE WHEN direction = 'middle' THEN CASE WHEN impact > 0 THEN 'typical orders' ELSE 'unusual orders' END
     WHEN impact > 0 THEN 'high orders' ELSE 'low orders' END
  ELSE CASE WHEN (direction = 'higher') = (impact > 0) THEN 'the distance to suppliers' WHEN impact > 0 THEN 'suppliers nearby' ELSE 'suppliers close by' END END AS w,
  row_number() OVER (PARTITION BY search, area ORDER BY abs(round(impact, 9)) DESC, metric) AS k FROM allp WHERE abs(impact) >= 1),
sides AS (SELECT search, area, list(w ORDER BY k) FILTER (WHERE impact > 0) AS p, list(w ORDER BY k) FILTER (WHERE impact < 0) AS n FROM worded WHERE k <= 3 GROUP BY ALL),
txt AS (SELECT search, area, CASE WHEN len(p) < 3 THEN array_to_string(p, ' and ') ELSE array_to_string(p[:-2], ', ') || ' and ' || p[-1] END AS p,
  CASE WHEN len(n) < 3 THEN array_to_string(n, ' and ') ELSE array_to_string(n[:-2], ', ') || ' and ' || n[-1] END AS n FROM sides)"""


@query("F16 F18", with_(*AREA_SQL, ALL_PARTS, select="""SELECT a.search, a.area, CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN 'Helped by ' || p || '; held back by ' || n || '.'
   WHEN p IS NOT NULL THEN 'Helped by ' || p || '.' WHEN n IS NOT NULL THEN 'Held back by ' || n || '.' ELSE 'About average on everything you asked for.' END AS sentence
   FROM (SELECT DISTINCT search, area FROM allp) a LEFT JOIN txt ON txt.search = a.search AND txt.area = a.area"""))
def area_trade_offs(t):
    mine = parts(t).select("search", "area", "metric", "level", "direction", r("impact", 9).alias("impact"), "budget")
    where = areas(t).filter(area.residential()).select("area", "county")
    theirs = county_known(t).join(where, "county").select(
        "search", "area", "metric", F.lit("county").alias("level"), "direction", r("impact", 9).alias("impact"),
        F.lit(None).cast("double").alias("budget"))
    return area.trade_off(mine.unionByName(theirs), "area", definitions(t), t.rows(WORDINGS, "unit string, direction string, ending string, text string"))


@query("E10", with_(*base.PLACE_SQL, """lab AS (SELECT place, segment || ' ' || (place % 40) AS label, CASE WHEN place % 23 <> 0 THEN lat END AS lat, lon FROM places)""",
  """mid AS (SELECT label, count(*) AS n, avg(CASE WHEN lat IS NOT NULL THEN lat END) AS clat, avg(CASE WHEN lat IS NOT NULL THEN lon END) AS clon FROM lab GROUP BY 1),
  off AS (SELECT place, label, n, sqrt(pow((lon - clon) * cos(radians(clat)), 2) + pow(lat - clat, 2)) AS d,
    atan2(lat - clat, (lon - clon) * cos(radians(clat))) AS a FROM lab JOIN mid USING (label)),
  dirs AS (SELECT *, CASE WHEN d IS NULL THEN 'area' WHEN d <= 0.25 * max(d) OVER (PARTITION BY label) THEN 'central' ELSE
    ['east','northeast','north','northwest','west','southwest','south','southeast'][1 + (floor(fmod(a + 2 * pi(), 2 * pi()) / (pi() / 4) + 0.5)::INT % 8)] END AS dir FROM off),
  num AS (SELECT *, row_number() OVER (PARTITION BY label, dir ORDER BY d NULLS LAST, place) AS k FROM dirs)""",
  select="SELECT place, CASE WHEN n = 1 THEN label ELSE label || ' · ' || dir || CASE WHEN k > 1 THEN ' ' || k ELSE '' END END AS name FROM num"))
def area_distinct_names(t):
    p = base.places(t)
    named = p.select("place", F.concat_ws(" ", "segment", (F.col("place") % 40).cast("string")).alias("label"),
                     F.when(F.col("place") % 23 != 0, F.col("lat")).alias("lat"), "lon")
    return area.distinct_names(named, "place").select("place", "name")
