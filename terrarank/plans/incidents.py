"""Incidents and agencies: event users as agencies, event types as offenses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crime
from . import base
from .registry import query, r, rs, shared, with_

VIOLENT, PROPERTY, PER_OFFENSE = ["click", "purchase"], ["view"], ["purchase"]
AG = """ag AS (SELECT DISTINCT user_id AS agency_id, (user_id % 25)::BIGINT AS county, CASE WHEN user_id % 9 <> 0 THEN 1000 + user_id * 977 % 60000 END AS population FROM events),
  ev AS (SELECT event_id AS offense_id, event_id // 2 AS incident_id, user_id AS agency_id, event_type AS code, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 4 END AS victims, 1 + day(ts) % 12 AS m FROM events),
  red AS (SELECT ag.agency_id, county, population, coalesce(months, 0) AS months, coalesce(violent, 0)::BIGINT AS violent, coalesce(property, 0) AS property FROM ag
   LEFT JOIN (SELECT agency_id, count(DISTINCT m) AS months FROM ev WHERE agency_id % 7 <> 0 OR m < 3 GROUP BY 1) USING (agency_id)
   LEFT JOIN (SELECT agency_id, sum(CASE WHEN code = 'purchase' THEN 1 WHEN code = 'click' THEN greatest(victims, 1) ELSE 0 END) AS violent, count(*) FILTER (WHERE code = 'view') AS property FROM ev WHERE code IN ('click', 'purchase', 'view') GROUP BY 1) USING (agency_id)),
  rt AS (SELECT *, CASE WHEN population > 0 AND months > 0 THEN violent * 1200000 / (population * months)::DOUBLE END AS vr, CASE WHEN population > 0 AND months > 0 THEN property * 1200000 / (population * months)::DOUBLE END AS pr FROM red)"""


@shared
def reduced(t):
    e = t.events
    k = F.col("user_id")
    agencies = e.select(k.alias("agency_id")).distinct().select(
        "agency_id", (F.col("agency_id") % 25).alias("county"), F.when(F.col("agency_id") % 9 != 0, 1000 + F.col("agency_id") * 977 % 60000).alias("population"))
    m = (1 + F.dayofmonth("ts") % 12).alias("month_num")
    months = e.select(k.alias("agency_id"), m).filter((F.col("agency_id") % 7 != 0) | (F.col("month_num") < 3))
    offenses = e.select(F.col("event_id").alias("offense_id"), F.col("event_id").alias("incident_id"), F.col("event_type").alias("offense_code"))
    incidents = e.select(F.col("event_id").alias("incident_id"), k.alias("agency_id"))
    n = F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("event_id") % 4)
    victims = e.select(F.col("event_id").alias("offense_id"), n.alias("n")).filter("n > 0").select("offense_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return crime.reduce_incidents(agencies, months, offenses, incidents, victims.select("offense_id"), VIOLENT, PROPERTY, PER_OFFENSE)


@query("D21", with_(AG, select="SELECT * FROM red"))
def incident_reduction(t):
    return reduced(t).select("agency_id", "county", "population", "months", "violent", "property")


@shared
def rated(t):
    a = reduced(t)
    return a.withColumns({"vr": crime.yearly_rate("violent", "population", "months"), "pr": crime.yearly_rate("property", "population", "months")})


@query("D22 D23", with_(AG, select=f"""SELECT agency_id, {rs('vr')} AS violent_rate, {rs('pr')} AS property_rate, CASE WHEN months < 3 THEN 'months' WHEN population * months / 12.0::DOUBLE < 2500 THEN 'exposure'
   WHEN population IS NOT NULL AND vr IS NOT NULL AND ((population >= 50000 AND vr < 20 AND NOT coalesce(pr >= 500, false)) OR (population >= 5000 AND pr < 100) OR (population >= 5000 AND pr = 0)) THEN 'implausible' END AS note,
   floor(vr * population * months / 12 / 100000 + 0.5)::BIGINT AS reported FROM rt"""))
def agency_rates(t):
    a = rated(t)
    return a.select("agency_id", r("vr").alias("violent_rate"), r("pr").alias("property_rate"), crime.rate_note("population", "months", "vr", "pr").alias("note"),
                    crime.crimes_reported("vr", "population", "months").alias("reported"))


@query("D24 G1", """WITH a AS (SELECT user_id AS agency, 2023 + event_id % 2 AS y, count(DISTINCT 1 + day(ts) % 12) AS months, count(*) AS n FROM events GROUP BY ALL)
  SELECT agency, y::BIGINT AS y, months, n FROM (SELECT *, row_number() OVER (PARTITION BY agency ORDER BY months DESC, y DESC) AS k FROM a) WHERE k = 1""".replace("2023 + event_id % 2 AS y", "y").replace("FROM events GROUP BY ALL", "FROM (SELECT *, 2023 + event_id % 2 AS y FROM events) GROUP BY ALL"))
def most_complete_record(t):
    e = t.events.withColumn("y", 2023 + F.col("event_id") % 2).groupBy(F.col("user_id").alias("agency"), "y").agg(
        F.count_distinct(1 + F.dayofmonth("ts") % 12).alias("months"), F.count("*").alias("n"))
    newer, older = e.filter("y = 2024"), e.filter("y = 2023")
    return crime.most_complete(newer.unionByName(older), ["agency"], "months", "y").select("agency", "y", "months", "n")


@query("D29 G1", """WITH a AS (SELECT user_id AS agency, d AS y, count(*) AS n FROM (SELECT *, day(ts) % 3 AS d FROM events) GROUP BY ALL)
  SELECT agency, y::BIGINT AS y, n FROM (SELECT *, row_number() OVER (PARTITION BY agency ORDER BY n DESC, y) AS k FROM a) WHERE k = 1""")
def largest_yearly_record(t):
    a = t.events.groupBy(F.col("user_id").alias("agency"), (F.dayofmonth("ts") % 3).cast("long").alias("y")).agg(F.count("*").alias("n"))
    return crime.largest_record(a, ["agency"], "n", [F.asc("y")])


@query("D25", with_(AG, """k AS (SELECT *, CASE WHEN agency_id % 3 = 0 THEN 'County' ELSE 'State Police' END AS kind FROM red)""",
  select="SELECT county, sum(population)::BIGINT AS population, min(months) AS months, sum(violent)::BIGINT AS violent, sum(property)::BIGINT AS property FROM k GROUP BY 1 HAVING count(DISTINCT kind) > 1"))
def combined_patrols(t):
    kind = F.when(F.col("agency_id") % 3 == 0, "County").otherwise("State Police")
    rows = reduced(t).withColumn("kind", kind)
    return crime.combine_patrols(rows, "county", "kind").select("county", "population", "months", "violent", "property")


POLICED = """pol AS (SELECT place, county, CASE WHEN place % 3 = 0 THEN 'N' || county || ' County (sheriff)' WHEN place % 3 = 1 THEN 'City ' || county END AS agency, population, orders * orders * 3 + 1.0::DOUBLE AS density,
   CASE WHEN place % 3 < 2 AND county % 7 <> 3 THEN CASE WHEN county % 5 = 0 THEN 0.0 ELSE 100.0 + county * 3 + place % 3 END::DOUBLE END AS vr, CASE WHEN county % 5 = 0 THEN 0.0::DOUBLE ELSE 900.0 + county END AS pr, 5000 + county * 100 + place % 3 AS people FROM places),
  live AS (SELECT * FROM pol WHERE vr IS NOT NULL AND population > 50 AND agency IS NOT NULL),
  sh AS (SELECT county, agency, count(*) AS n, quantile_cont(density, 0.1) AS p10, quantile_cont(density, 0.9) AS p90 FROM live GROUP BY ALL),
  sr AS (SELECT pol.*, CASE WHEN vr IS NOT NULL THEN n END AS crime_shared, vr IS NOT NULL AND coalesce(pol.agency LIKE '%County (sheriff%' AND n >= 8 AND p90 >= 10 * greatest(p10, 1), false) AS crime_wide FROM pol LEFT JOIN sh ON sh.county = pol.county AND sh.agency = pol.agency)"""


@shared
def policed(t):
    k, c = F.col("place"), F.col("county")
    agency = F.when(k % 3 == 0, F.concat(F.lit("N"), c.cast("string"), F.lit(" County (sheriff)"))).when(k % 3 == 1, F.concat(F.lit("City "), c.cast("string")))
    rate = F.when((k % 3 < 2) & (c % 7 != 3), F.when(c % 5 == 0, 0.0).otherwise(100.0 + c * 3 + k % 3))
    rows = base.places(t).select(
        k, c, agency.alias("agency"), "population", (F.col("orders") * F.col("orders") * 3 + 1.0).alias("density"), rate.alias("violent_rate"),
        F.when(c % 5 == 0, 0.0).otherwise(900.0 + c).alias("property_rate"), (5000 + c * 100 + k % 3).alias("people"))
    return crime.shared_rates(rows, "place", "county", "agency", "density", "population", "violent_rate")


@query("D26", with_(*base.PLACE_SQL, POLICED, select="SELECT place, crime_shared, crime_wide FROM sr"))
def shared_agency_rates(t):
    return policed(t).select("place", "crime_shared", "crime_wide")


USABLE = """ok AS (SELECT *, vr IS NOT NULL AND NOT (vr = 0 AND pr = 0) AS usable FROM sr), al AS (SELECT county, agency, max(people) AS people, count(*) AS areas FROM ok WHERE usable GROUP BY ALL)"""


@query("D27", with_(*base.PLACE_SQL, POLICED, USABLE, """vw AS (SELECT *, CASE WHEN usable AND NOT crime_wide THEN CASE WHEN crime_shared >= 100 THEN 'city' ELSE 'own' END END AS v0, (SELECT count(*) FROM al WHERE al.county = ok.county) - CASE WHEN usable THEN 1 ELSE 0 END AS o FROM ok)""",
   select="""SELECT place, coalesce(v0, CASE WHEN usable OR o > 0 THEN 'nearby' ELSE 'none' END) AS view, CASE WHEN v0 IS NULL AND (usable OR o > 0) THEN o END AS others FROM vw"""))
def crime_views(t):
    return crime.crime_view(policed(t), "place", "county", "agency").select("place", "view", "others")


@query("D27", with_(*base.PLACE_SQL, POLICED, USABLE, select="SELECT county, agency, people, areas FROM al"))
def county_agencies(t):
    return crime.county_agencies(policed(t), "county", "agency")


@query("D28", """WITH w AS (SELECT user_id AS agency, event_type AS cat, month(ts) * 100 + day(ts) % 6 AS m, count(*) FILTER (WHERE value > 60) AS n FROM events GROUP BY ALL)
  SELECT agency, count(DISTINCT m) FILTER (WHERE tot > 0) AS months, sum(n) FILTER (WHERE cat IN ('click', 'purchase'))::BIGINT AS violent, sum(n) FILTER (WHERE cat = 'view')::BIGINT AS property
  FROM (SELECT *, sum(n) OVER (PARTITION BY agency, m) AS tot FROM w WHERE cat IN ('click', 'purchase', 'view')) GROUP BY 1""".replace("month(ts) * 100 + day(ts) % 6 AS m, count(*)", "m, count(*)").replace("FROM events GROUP BY ALL", "FROM (SELECT *, day(ts) % 6 AS m FROM events) GROUP BY ALL"))
def months_reported(t):
    cats, slots = ["click", "purchase", "view"], list(range(6))
    slot = F.dayofmonth("ts") % 6
    wide = t.events.groupBy(F.col("user_id").alias("agency")).agg(
        *[F.count_if((F.col("event_type") == c) & (slot == s) & (F.col("value") > 60)).alias(f"{c}_{s}") for c in cats for s in slots])
    months = {f"{c}_{s}": str(s) for c in cats for s in slots}
    out = crime.months_with_reports(wide, "agency", months, ["click", "purchase"], ["view"], {f"{c}_{s}": c for c in cats for s in slots})
    return out.select("agency", "months", "violent", "property")
