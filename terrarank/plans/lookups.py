"""Place index and lookup, saved searches, and the joins that build wide tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import measures
from ..functions.text import civil_kind, civil_name
from ..operators import joins, places, preferences
from . import base
from .columns import LABELS, labels
from .registry import query, r, rs, shared, with_

INDEXED = """ar AS (SELECT l.p_partkey AS area, l.p_partkey % 25 AS county, label, p_size * 10 AS population, CASE WHEN l.p_partkey % 17 <> 0 THEN 25 + (l.p_partkey * 37 % 2500) / 100.0::DOUBLE END AS lat,
   -125 + (l.p_partkey * 91 % 5800) / 100.0::DOUBLE AS lon, hood, coalesce(place, near, 'Unincorporated Travis') AS city, place IS NULL AND near IS NOT NULL AND hood IS NULL AS near, zip FROM lbl l JOIN part USING (p_partkey)),
  co AS (SELECT n_nationkey::BIGINT AS county, n_name || ' County' AS county_name, 'S' || n_regionkey AS state, (n_nationkey * 1000)::DOUBLE AS population FROM nation),
  ex AS (SELECT 'city' AS kind, city AS name, NULL AS in_city, state AS st, near AS beside, area, ar.county, city, ar.population, lat, lon FROM ar JOIN co USING (county)
   UNION ALL SELECT 'neighborhood', hood, city, state, false, area, ar.county, city, ar.population, lat, lon FROM ar JOIN co USING (county) WHERE hood IS NOT NULL
   UNION ALL SELECT 'zip', zip, NULL, '', false, area, ar.county, city, ar.population, lat, lon FROM ar JOIN co USING (county) WHERE zip IS NOT NULL),
  ks AS (SELECT kind, name, in_city, st, min(beside) AS near FROM ex GROUP BY ALL),
  ke AS (SELECT ex.*, ks.near FROM ex JOIN ks ON ex.kind = ks.kind AND ex.name = ks.name AND ex.in_city IS NOT DISTINCT FROM ks.in_city AND ex.st = ks.st AND ex.beside = ks.near),
  kc AS (SELECT kind, name, in_city, st, arg_max(county, (w, -county)) AS county, count(*) AS n FROM (SELECT kind, name, in_city, st, county, sum(population + 1) AS w FROM ke GROUP BY ALL) GROUP BY ALL),
  kz AS (SELECT name, arg_max(city, (w, city)) AS zc FROM (SELECT name, city, sum(population + 1) AS w FROM ke WHERE kind = 'zip' GROUP BY ALL) GROUP BY 1),
  kw AS (SELECT kind, name, in_city, st, near, count(*) AS areas, sum(population)::DOUBLE AS population, min(lat) AS south, max(lat) AS north, min(CASE WHEN lat IS NOT NULL THEN lon END) AS west, max(CASE WHEN lat IS NOT NULL THEN lon END) AS east FROM ke GROUP BY ALL),
  ix AS (SELECT kw.kind, kw.name, kw.near, kw.areas, kw.population, south, north, west, east, kc.county, CASE WHEN kw.st <> '' THEN kw.st ELSE co.state END AS state,
    CASE kw.kind WHEN 'city' THEN co.county_name || CASE WHEN n > 1 THEN ' + ' || (n - 1) || ' more' ELSE '' END || ', ' || kw.st WHEN 'neighborhood' THEN kw.in_city || ', ' || kw.st ELSE zc || ', ' || co.state END AS "where"
    FROM kw JOIN kc ON kw.kind = kc.kind AND kw.name = kc.name AND kw.in_city IS NOT DISTINCT FROM kc.in_city AND kw.st = kc.st JOIN co ON co.county = kc.county LEFT JOIN kz ON kw.kind = 'zip' AND kz.name = kw.name
   UNION ALL SELECT 'county', county_name, false, 0, population, NULL, NULL, NULL, NULL, county, state, state FROM co)"""


def counties(t):
    n = F.col("n_nationkey").cast("long")
    return t.nation.select(n.alias("county"), F.concat(F.col("n_name"), F.lit(" County")).alias("county_name"),
                           F.concat(F.lit("S"), F.col("n_regionkey").cast("string")).alias("state"), (n * 1000).cast("double").alias("population"))


def areas(t):
    k = F.col("p_partkey")
    return labels(t).select(k, "label").join(t.part.select(k, "p_size"), "p_partkey").select(
        k.alias("area"), (k % 25).alias("county"), "label", (F.col("p_size") * 10).alias("population"),
        F.when(k % 17 != 0, 25 + (k * 37 % 2500) / 100.0).alias("lat"), (-125 + (k * 91 % 5800) / 100.0).alias("lon"))


@shared
def index(t):
    return places.place_index(areas(t), counties(t))


@query("D41", with_(LABELS, INDEXED, select="""SELECT kind, name, "where", state, county, near, areas, population, south, north, west, east FROM ix"""))
def place_index(t):
    return index(t).select("kind", "name", "where", "state", "county", "near", "areas", "population", "south", "north", "west", "east")




LOOKUPS = [("q1", "nation_1 county"), ("q2", "Brand#1"), ("q3", "brand s2"), ("q4", "b"), ("q5", "PROMO brand"), ("q6", "nation 12"), ("q7", "standard")]


def _norm_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


MATCHES = f"""pl AS (SELECT *, {_norm_sql('name')} AS norm, CASE WHEN kind = 'county' THEN regexp_replace({_norm_sql('name')}, ' county$', '') END AS short,
    CASE WHEN kind IN ('neighborhood', 'zip') THEN string_split({_norm_sql('"where"')}, ' ') ELSE [lower(state)] END AS ctx FROM ix),
  tq AS (SELECT query_id, {_norm_sql('txt')} AS n FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in LOOKUPS)}) v(query_id, txt) UNION ALL SELECT 'n' || n_nationkey, {_norm_sql('n_name')} FROM nation),
  tk AS (SELECT query_id, string_split(n, ' ') AS tk FROM tq WHERE length(n) >= 2),
  cd AS (SELECT *, unnest(range(1, len(tk) + 1)) AS k FROM pl CROSS JOIN tk WHERE starts_with(norm, tk[1]) OR contains(norm, ' ' || tk[1])),
  cm AS (SELECT *, array_to_string(tk[1:k], ' ') AS head FROM cd WHERE len(list_filter(tk[k + 1:], lambda a: len(list_filter(ctx, lambda b: starts_with(b, a))) = 0)) = 0),
  cq AS (SELECT *, CASE WHEN norm = head OR coalesce(short = head, false) THEN 3 WHEN starts_with(norm, head) THEN 2
      WHEN len(list_filter(tk[1:k], lambda a: NOT (starts_with(norm, a) OR contains(norm, ' ' || a)))) = 0 THEN 1 ELSE 0 END AS quality FROM cm),
  cb AS (SELECT query_id, kind, name, "where", population, arg_max(quality, k) AS quality FROM cq WHERE quality > 0 GROUP BY query_id, kind, name, "where", population)"""


@query("F24 F25", with_(LABELS, INDEXED, MATCHES, select="""SELECT query_id, kind, name, "where", population, quality::BIGINT AS quality, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, population DESC, name, "where") AS position FROM cb) WHERE position <= 8"""))
def place_lookup(t):
    typed = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("query_id"), F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("text"))
    queries = t.rows(LOOKUPS, "query_id string, text string").unionByName(typed)
    hits = places.search_places(index(t), queries)
    return hits.select("query_id", "kind", "name", "where", "population", F.col("quality").cast("long"), F.col("position").cast("long"))


OTHER = [("o1", "borough 5"), ("o2", "nation 1 region 1"), ("o3", "nation 1 region 2"), ("o4", "b"), ("o5", "brand region"), ("o6", "borough 9 s1")]
NAMED = """ia AS (SELECT ix.*, 'Region ' || substr(state, 2) AS state_name FROM ix UNION ALL SELECT 'county', 'Borough ' || county, false, 0, population, NULL, NULL, NULL, NULL, county, state, county_name || ', ' || state,
   'Region ' || substr(state, 2) FROM co WHERE county % 4 = 1)"""
OTHER_MATCHES = (MATCHES.replace("FROM ix)", "FROM ia)").replace("ELSE [lower(state)] END AS ctx", f"ELSE [lower(state)] END || string_split({_norm_sql('state_name')}, ' ') AS ctx")
                 .replace(", ".join(f"('{a}', '{b}')" for a, b in LOOKUPS), ", ".join(f"('{a}', '{b}')" for a, b in OTHER)))


@query("F24", with_(LABELS, INDEXED, NAMED, OTHER_MATCHES, select="""SELECT query_id, kind, name, "where", population, quality::BIGINT AS quality, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, population DESC, name, "where") AS position FROM cb) WHERE position <= 8"""))
def lookup_by_other_names(t):
    typed = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("query_id"), F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("text"))
    named = counties(t).withColumns({"state_name": F.concat(F.lit("Region "), F.substring("state", 2, 9)),
                                     "also": F.when(F.col("county") % 4 == 1, F.concat(F.lit("Borough "), F.col("county").cast("string")))})
    hits = places.search_places(places.place_index(areas(t), named), t.rows(OTHER, "query_id string, text string").unionByName(typed))
    return hits.select("query_id", "kind", "name", "where", "population", F.col("quality").cast("long"), F.col("position").cast("long"))


@query("D41", with_(LABELS, """g AS (SELECT coalesce(place, 'Near ' || near, 'Unincorporated') AS "group", p_size FROM lbl JOIN part USING (p_partkey))""",
  select="""SELECT "group", count(*) AS areas, sum(p_size)::BIGINT AS population FROM g GROUP BY 1"""))
def areas_by_group(t):
    rows = labels(t).join(t.part.select("p_partkey", F.col("p_size").cast("long").alias("population")), "p_partkey")
    return places.group_areas(rows, F.coalesce("place", F.concat(F.lit("Near "), F.col("near")), F.lit("Unincorporated")))


@shared
def saved(t):
    """One saved search per customer."""
    k = F.col("c_custkey")
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda on, level, metric, weight, direction=None, high=None: F.when(on, F.struct(
        F.lit(level).alias("level"), F.lit(metric).alias("metric"), weight.cast("double").alias("weight"),
        (none("string") if direction is None else direction).alias("direction"), none("double").alias("min"),
        (none("double") if high is None else high).alias("max")))
    yes = F.lit(True)
    said = F.array_compact(F.array(
        row(yes, "county", "median_home_value", k % 8 - 1, F.when(k % 3 == 0, "lower"), F.when(k % 4 == 0, 300000.0)),
        row(k % 5 == 0, "area", "median_home_value", F.lit(2)), row(yes, "county", "rpp_rents", k % 6), row(k % 2 == 0, "county", "rpp_goods", k % 4),
        row(yes, "county", "sales_tax_combined", k % 5, F.lit("sideways"), F.when(k % 3 == 1, 8.0)), row(k % 7 == 0, "county", "taxes", F.lit(1), F.lit("higher")),
        row(yes, "county", "nonsense", F.lit(3)), row(yes, "county", "racial_equality", F.lit(5))))
    return t.customer.select(k.alias("search"), F.explode(said).alias("s")).select("search", "s.*")


SAVED = """nm AS (SELECT c_custkey AS search, 'area' AS level, 'median_home_value' AS metric, CASE WHEN c_custkey % 5 = 0 THEN 2.0 ELSE greatest(0, least(5, c_custkey % 8 - 1)) END::DOUBLE AS weight, CASE WHEN c_custkey % 3 = 0 THEN 'lower' END AS direction, NULL::DOUBLE AS min,
    CASE WHEN c_custkey % 4 = 0 THEN 300000.0 END::DOUBLE AS max FROM customer
  UNION ALL SELECT c_custkey, 'county', 'rpp_all', greatest(least(5, c_custkey % 6), CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 ELSE 0 END)::DOUBLE, NULL, NULL, NULL FROM customer WHERE c_custkey % 6 > 0 OR (c_custkey % 2 = 0 AND c_custkey % 4 > 0)
  UNION ALL SELECT c_custkey, 'county', 'sales_tax_combined', NULL, NULL, NULL, 8.0 FROM customer WHERE c_custkey % 3 = 1
  UNION ALL SELECT c_custkey, 'county', 'taxes', CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE c_custkey % 5 END::DOUBLE, NULL, NULL, NULL FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 > 0)"""


@query("F22", with_(SAVED, select="SELECT * FROM nm"))
def normalized_searches(t):
    return preferences.normalize(saved(t), *preferences.definitions_for(t.spark))


@query("F7", with_(SAVED, select="""SELECT search, metric, weight, 'lower' AS direction, CASE WHEN search % 2 = 0 AND c_acctbal > 0 THEN c_acctbal * 50 END AS budget, 0::BIGINT AS position
  FROM nm JOIN customer ON c_custkey = search WHERE level = 'area' AND weight > 0"""))
def area_criteria_from_searches(t):
    normal = preferences.normalize(saved(t), *preferences.definitions_for(t.spark))
    budgets = t.customer.select(F.col("c_custkey").alias("search"), F.when(F.col("c_custkey") % 2 == 0, "buy").alias("tenure"), (F.col("c_acctbal") * 50).alias("budget"))
    c = preferences.area_criteria(normal, measures.area_measures(t.spark), budgets)
    return c.select("search", "metric", "weight", "direction", "budget", F.col("position").cast("long"))


@query("C1 B29", f"""SELECT c_custkey, c_name, n, {rs('total')} AS total, {rs('late')} AS late FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1) o ON o_custkey = c_custkey
   LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS late FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1) p ON p.k = c_custkey""")
def wide_table(t):
    key = F.col("o_custkey").alias("c_custkey")
    a = t.orders.filter("o_custkey % 5 <> 0").groupBy(key).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    b = t.orders.filter("o_custkey % 3 = 0").groupBy(key).agg(F.max("o_totalprice").alias("late"))
    wide = joins.join_sources(t.customer.select("c_custkey", "c_name"), "c_custkey", {"a": a, "absent": None, "b": b})
    out = wide.select("c_custkey", "c_name", "n", r("total").alias("total"), r("late").alias("late"))
    return joins.order_columns(out, ["c_custkey", "late", "n"])


@query("C1", f"""WITH w AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 1 END AS a, CASE WHEN c_custkey % 3 = 0 THEN 1 END AS b FROM customer)
  SELECT 'a' AS source, {rs('100.0 * count(a) / count(*)')} AS coverage FROM w UNION ALL SELECT 'b', {rs('100.0 * count(coalesce(a, b)) / count(*)')} FROM w""")
def source_coverage(t):
    k = F.col("c_custkey")
    w = t.customer.select(k, F.when(k % 5 != 0, 1).alias("a"), F.when(k % 3 == 0, 1).alias("b"))
    c = joins.source_coverage(w, {"a": ["a"], "b": ["a", "b"]})
    return c.select("source", r("coverage").alias("coverage"))


@query("C2", """WITH m AS (SELECT n_nationkey AS k, 100 + n_nationkey AS v FROM nation WHERE n_nationkey % 3 = 0), nm AS (SELECT r_regionkey AS k, 50 + r_regionkey AS v FROM region WHERE r_regionkey % 2 = 0), st AS (SELECT r_regionkey AS k, r_regionkey AS v FROM region WHERE r_regionkey <> 3)
  SELECT c_custkey, coalesce(m.v, nm.v, st.v)::BIGINT AS index_value, CASE WHEN m.v IS NOT NULL THEN 'metro' WHEN nm.v IS NOT NULL THEN 'nonmetro' WHEN st.v IS NOT NULL THEN 'state' END AS level,
   CASE WHEN m.v IS NOT NULL THEN n_nationkey WHEN coalesce(nm.v, st.v) IS NOT NULL THEN n_regionkey END::VARCHAR AS level_key
  FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN m ON m.k = n_nationkey LEFT JOIN nm ON nm.k = n_regionkey LEFT JOIN st ON st.k = n_regionkey""")
def fallback_assignment(t):
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "c_custkey", F.col("n_nationkey").alias("metro"), F.col("n_regionkey").alias("state"))
    m = t.nation.filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("metro"), (100 + F.col("n_nationkey")).cast("long").alias("index_value"))
    nm = t.region.filter("r_regionkey % 2 = 0").select(F.col("r_regionkey").alias("state"), (50 + F.col("r_regionkey")).cast("long").alias("index_value"))
    st = t.region.filter("r_regionkey <> 3").select(F.col("r_regionkey").alias("state"), F.col("r_regionkey").cast("long").alias("index_value"))
    out = joins.with_fallback(rows, [("metro", m, "metro"), ("nonmetro", nm, "state"), ("state", st, "state")], ["index_value"])
    return out.select("c_custkey", "index_value", "level", "level_key")


@query("C3", """SELECT c_custkey, CASE WHEN n_regionkey <> 2 THEN 4.5::DOUBLE + n_regionkey END AS sales_tax, CASE WHEN n_regionkey % 2 = 0 THEN 'medical' ELSE 'illegal' END AS status FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def state_facts_on_places(t):
    rk = F.col("r_regionkey")
    sales = t.region.select(rk.alias("state"), F.lit("sales_tax").alias("law"), F.when(rk != 2, (4.5 + rk).cast("string")).alias("value"), F.lit(None).cast("double").alias("value_numeric"))
    status = t.region.select(rk.alias("state"), F.lit("status").alias("law"), F.when(rk % 2 == 0, "medical").otherwise("illegal").alias("value"), F.lit(None).cast("double").alias("value_numeric"))
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("n_regionkey").alias("state"))
    return joins.apply_facts(rows, sales.unionByName(status), "state", ["sales_tax"], ["status"]).select("c_custkey", "sales_tax", "status")


@query("B18", """WITH nm AS (SELECT p_partkey AS k, p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 1000000 ELSE 0 END AS id,
    CASE WHEN p_partkey % 4 IN (0, 3) THEN 'only ' || p_partkey WHEN p_partkey % 4 = 2 THEN 'only ' || (p_partkey + 1) ELSE p_name END AS nm FROM part),
  cur AS (SELECT k AS id, nm FROM nm WHERE k % 3 <> 0), u AS (SELECT nm, min(id) AS id FROM cur GROUP BY 1 HAVING count(*) = 1)
  SELECT k AS row_id, CASE WHEN u.id IS NOT NULL AND nm.id NOT IN (SELECT id FROM cur) AND u.id NOT IN (SELECT id FROM nm) THEN u.id ELSE nm.id END AS id
  FROM nm LEFT JOIN u USING (nm)""")
def repaired_keys(t):
    """Even keys are out of date: those with a name of their own are repaired, unless the new key is taken or the name is shared."""
    k = F.col("p_partkey")
    name = F.when((k % 4).isin(0, 3), F.concat(F.lit("only "), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("only "), (k + 1).cast("string"))).otherwise(F.col("p_name"))
    named = t.part.select(k, name.alias("nm"))
    cur = named.filter(k % 3 != 0).select(k.alias("id"), "nm")
    rows = named.select(k.alias("row_id"), (k + F.when(k % 2 == 0, 1000000).otherwise(0)).alias("id"), "nm")
    return joins.rekey_by_name(rows, "id", "nm", cur).select("row_id", "id")


@query("C18 A7", f"""WITH z AS (SELECT l_partkey AS zip, l_shipdate, avg(l_extendedprice) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), n AS (SELECT zip, p FROM z WHERE l_shipdate = (SELECT max(l_shipdate) FROM z))
  SELECT o_orderkey, zip, {rs('p')} AS price FROM (SELECT o_orderkey, o_orderkey % 2000 AS zip FROM orders) LEFT JOIN n USING (zip)""")
def newest_period_market(t):
    from ..sources.periods import newest_period

    z = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("zip"), "l_shipdate").agg(F.avg("l_extendedprice").alias("p"))
    n = newest_period(z, "l_shipdate").select("zip", "p")
    rows = t.orders.select("o_orderkey", (F.col("o_orderkey") % 2000).alias("zip"))
    return rows.join(n, "zip", "left").select("o_orderkey", "zip", r("p").alias("price"))


@query("C20", with_(*base.PLACE_SQL, "c AS (SELECT s_acctbal AS v FROM supplier)", select=f"SELECT place, {rs('CASE WHEN balance IS NOT NULL THEN 100.0::DOUBLE * (SELECT count(*) FROM c WHERE v <= balance) / (SELECT count(*) FROM c) END')} AS standing FROM places"))
def standing_in_other_table(t):
    from ..operators.rank import share_at_or_below

    s = share_at_or_below(base.places(t).select("place", "balance"), "balance", t.supplier, "s_acctbal", "standing")
    return s.select("place", r("standing").alias("standing"))


@query("C21", """WITH a AS (SELECT c_custkey AS area, 'P' || c_custkey % 60 AS place, 'T' || c_custkey % 25 AS town, c_nationkey AS county, 100 + c_custkey % 7 AS pop FROM customer),
  ag AS (SELECT s_suppkey AS agency, CASE s_suppkey % 3 WHEN 0 THEN 'P' || s_suppkey % 50 WHEN 1 THEN 'T' || s_suppkey % 30 END AS nm, s_nationkey AS county, CASE s_suppkey % 3 WHEN 1 THEN 600 + s_suppkey ELSE 100000 END AS people, s_suppkey % 3 AS kind FROM supplier),
  p AS (SELECT nm, min(agency) AS g FROM ag WHERE kind = 0 GROUP BY 1), t AS (SELECT nm, min(agency) AS g FROM ag WHERE kind = 1 GROUP BY 1), c AS (SELECT county, min(agency) AS g FROM ag WHERE kind = 2 GROUP BY 1),
  m AS (SELECT area, pop, coalesce(p.g, t.g, c.g) AS agency, CASE WHEN p.g IS NOT NULL THEN 'place' WHEN t.g IS NOT NULL THEN 'town' WHEN c.g IS NOT NULL THEN 'county' END AS how FROM a LEFT JOIN p ON p.nm = a.place LEFT JOIN t ON t.nm = a.town LEFT JOIN c ON c.county = a.county),
  s AS (SELECT m.agency FROM m JOIN ag ON ag.agency = m.agency GROUP BY m.agency, people HAVING sum(pop) > 2 * people)
  SELECT area, CASE WHEN how = 'town' AND agency IN (SELECT agency FROM s) THEN NULL ELSE agency END AS agency, CASE WHEN how = 'town' AND agency IN (SELECT agency FROM s) THEN NULL ELSE how END AS matched_by FROM m""")
def agency_match(t):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    areas = t.customer.select(k.alias("area"), F.concat(F.lit("P"), (k % 60).cast("string")).alias("place"), F.concat(F.lit("T"), (k % 25).cast("string")).alias("town"),
                              F.col("c_nationkey").alias("county"), (100 + k % 7).alias("pop"))
    ag = t.supplier.select(s.alias("agency"), F.col("s_nationkey").alias("county"), F.when(s % 3 == 0, F.concat(F.lit("P"), (s % 50).cast("string"))).when(
        s % 3 == 1, F.concat(F.lit("T"), (s % 30).cast("string"))).alias("nm"), F.when(s % 3 == 1, 600 + s).otherwise(100000).alias("people"))
    place = ag.filter("agency % 3 = 0").select(F.col("nm").alias("place"), "agency")
    town = ag.filter("agency % 3 = 1").select(F.col("nm").alias("town"), "agency")
    county = ag.filter("agency % 3 = 2").select("county", "agency")
    m = joins.candidate_match(areas, "area", [("place", place, ["place"]), ("town", town, ["town"]), ("county", county, ["county"])], "agency")
    return joins.undo_overserved(m, "area", "agency", "town", "pop", ag, "people").select("area", "agency", "matched_by")


@query("B19", """SELECT s_suppkey, 'hempstead' AS name_key, CASE s_suppkey % 4 WHEN 0 THEN 'village' WHEN 1 THEN 'township' WHEN 2 THEN 'town' END AS kind FROM supplier""")
def civil_names(t):
    k = F.col("s_suppkey")
    n = F.when(k % 4 == 0, "Hempstead Village").when(k % 4 == 1, "Hempstead Charter Township").when(k % 4 == 2, "HEMPSTEAD TOWN").otherwise("Hémpstead")
    return t.supplier.select(k, civil_name(n).alias("name_key"), civil_kind(n).alias("kind"))


@query("C22", """WITH a AS (SELECT o_custkey AS k, count(*) AS a FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS b FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1), c AS (SELECT c_custkey AS k, 1 AS c FROM customer WHERE c_custkey % 5 = 0)
  SELECT k, a, b, c FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""")
def outer_measures(t):
    k = F.col("o_custkey").alias("k")
    a = t.orders.filter("o_custkey % 2 = 0").groupBy(k).agg(F.count("*").alias("a"))
    b = t.orders.filter("o_custkey % 3 = 0").groupBy(k).agg(F.count("*").alias("b"))
    c = t.customer.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("c"))
    return joins.full_outer([a, b, c], ["k"])


@query("C23", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 3 <> 0), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 0)
  SELECT k, 'left' AS only_in FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def keys_on_one_side(t):
    return joins.missing_keys(t.orders.filter("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("k")),
                              t.customer.filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k")), "k")


@query("C24", """SELECT 'bal' AS "column", count(*) FILTER (WHERE k % 10 = 3) AS changed, 'changed' AS what FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 9 <> 0)
  UNION ALL SELECT 'seg', count(*) FILTER (WHERE k % 15 = 4 AND seg <> 'BUILDING'), 'changed' FROM (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_custkey % 9 <> 0)
  UNION ALL SELECT 'fresh', count(*), 'new column' FROM customer WHERE c_custkey % 9 <> 0 UNION ALL SELECT 'legacy', count(*), 'gone' FROM customer""")
def build_differences(t):
    k = F.col("c_custkey")
    old = t.customer.select(k, F.when(k % 7 != 0, F.col("c_acctbal")).alias("bal"), F.col("c_mktsegment").alias("seg"), F.lit(1).alias("legacy"))
    drift = F.when(k % 10 == 3, 1.0).otherwise(0.00001)
    new = t.customer.filter(k % 9 != 0).select(k, F.when(k % 7 != 0, F.col("c_acctbal") + drift).when(k % 10 == 3, 5.0).alias("bal"),
                                              F.when(k % 15 == 4, "BUILDING").otherwise(F.col("c_mktsegment")).alias("seg"), F.lit(2).alias("fresh"))
    return joins.build_diff(old, new, "c_custkey")


@query("C24", """WITH o AS (SELECT c_mktsegment AS g, count(*) AS n, round(max(c_acctbal)) AS v FROM customer GROUP BY 1), w AS (SELECT CASE WHEN c_custkey % 6 = 0 THEN '(none)' ELSE c_mktsegment END AS g, count(*) AS n, round(max(c_acctbal)) AS v FROM customer GROUP BY 1)
  SELECT coalesce(o.g, w.g) AS seg, coalesce(o.n, 0) AS rows_before, o.v AS value_before, coalesce(w.n, 0) AS rows_after, w.v AS value_after FROM o FULL JOIN w ON o.g = w.g WHERE coalesce(o.n, 0) <> coalesce(w.n, 0) OR o.v IS DISTINCT FROM w.v""")
def group_differences(t):
    old = t.customer.select(F.col("c_mktsegment").alias("seg"), "c_acctbal")
    new = t.customer.select(F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("seg"), "c_acctbal")
    return joins.group_diff(old, new, "seg", "c_acctbal")


@query("C28", with_(*base.PLACE_SQL, "l AS (SELECT 'balance' AS metric, place, balance AS v FROM places UNION ALL SELECT 'spend', place, spend FROM places UNION ALL SELECT 'orders', place, orders FROM places)",
  select="""SELECT metric, max(v) FILTER (WHERE place = 12) AS "12", max(v) FILTER (WHERE place = 57) AS "57", max(v) FILTER (WHERE place = 101) AS "101" FROM l WHERE place IN (12, 57, 101) AND v IS NOT NULL GROUP BY 1"""))
def side_by_side(t):
    return joins.compare_places(base.places(t), "place", [12, 57, 101], ["balance", "spend", "orders"])


@query("F28", with_(*base.PLACE_SQL, "h AS (SELECT place, 'flood' AS hz, place * 7 % 40 AS p FROM places UNION ALL SELECT place, 'fire', place * 11 % 40 FROM places UNION ALL SELECT place, 'wind', CASE WHEN place % 4 <> 0 THEN place * 3 % 40 END FROM places)",
  select="SELECT place, coalesce(string_agg(hz, ';' ORDER BY p DESC, hz) FILTER (WHERE p > 0), '') AS risky, coalesce(string_agg(hz, ';' ORDER BY hz) FILTER (WHERE p = 0), '') AS none FROM h GROUP BY 1"))
def hazards_by_risk(t):
    from ..operators.rank import unpivot

    k = F.col("place")
    rows = base.places(t).select(k, (k * 7 % 40).alias("flood"), (k * 11 % 40).alias("fire"), F.when(k % 4 != 0, k * 3 % 40).alias("wind"))
    long = unpivot(rows, ["place"], ["flood", "fire", "wind"])
    pack = F.collect_list(F.when(F.col("value") > 0, F.struct((-F.col("value")).alias("o"), "metric")))
    zero = F.array_sort(F.collect_list(F.when(F.col("value") == 0, F.col("metric"))))
    out = rows.select("place").join(long.groupBy("place").agg(
        F.array_join(F.transform(F.array_sort(pack), lambda x: x["metric"]), ";").alias("risky"), F.array_join(zero, ";").alias("none")), "place", "left")
    return out.na.fill("", ["risky", "none"])
