"""Distances and polygons: customers as places, suppliers as stations, nations as boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial
from . import base
from .registry import query, r, rs, shared, with_

STATIONS = """stations AS (SELECT s_suppkey AS station, s_nationkey::BIGINT AS district, 25 + (s_suppkey * 53 % 2500) / 100.0::DOUBLE AS lat,
   -125 + (s_suppkey * 77 % 5800) / 100.0::DOUBLE AS lon, CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal END AS temp,
   CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal / 10 END AS rain FROM supplier)"""


def hav(a: str, b: str) -> str:
    return (f"(2 * 3958.7613::DOUBLE * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * "
            f"cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))))")


PAIRS = f"pairs AS (SELECT place, county, station, district, temp, rain, {hav('p', 's')} AS miles FROM places p CROSS JOIN stations s)"
NEAR = (*base.PLACE_SQL, STATIONS, PAIRS)


@shared
def stations(t):
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("station"), F.col("s_nationkey").cast("long").alias("district"), (25 + (k * 53 % 2500) / 100.0).alias("lat"),
        (-125 + (k * 77 % 5800) / 100.0).alias("lon"), F.when(k % 9 != 0, F.col("s_acctbal")).alias("temp"),
        F.when(k % 3 != 0, F.col("s_acctbal") / 10).alias("rain"))


@query("C6 E7", with_(*NEAR, select=f"""SELECT place, station, {rs('miles')} AS miles, k AS position FROM (
   SELECT *, row_number() OVER (PARTITION BY place ORDER BY round(miles, 9), station) AS k FROM pairs) WHERE k <= 3"""))
def nearest_stations(t):
    n = spatial.nearest(base.places(t), "place", stations(t), "station", 3)
    return n.select("place", F.col("s_station").alias("station"), r("miles").alias("miles"), F.col("position").cast("long"))


@query("C7 A20", with_(*base.PLACE_SQL, STATIONS, """v AS (SELECT district AS line, station, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM stations WINDOW w AS (PARTITION BY district ORDER BY station))""",
  f"d AS (SELECT *, CASE WHEN plat IS NULL THEN 1 ELSE greatest(1, ceil({hav('a', 'b')} / 60)) END::INT AS n FROM (SELECT v.*, {{'lat': plat, 'lon': plon}} AS a, {{'lat': lat, 'lon': lon}} AS b FROM v))",
  "e AS (SELECT line, station, i, n, coalesce(plat + (lat - plat) * i / n, lat) AS lat, coalesce(plon + (lon - plon) * i / n, lon) AS lon FROM d, range(1, 200) x(i) WHERE i <= n)",
  select=f"SELECT place, {rs(f'min({hav(chr(112), chr(101))})')} AS miles FROM places p CROSS JOIN e GROUP BY 1"))
def distance_to_lines(t):
    pts = spatial.densify(stations(t), "district", "station", 60.0)
    pts = pts.withColumn("vertex", F.concat_ws("-", "station", "piece"))
    n = spatial.nearest(base.places(t), "place", pts, "vertex", 1)
    return n.select("place", r("miles").alias("miles"))


@query("C8 C9", with_(*NEAR, """ranked AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY round(miles, 9), station) AS k FROM pairs),
  near AS (SELECT * FROM ranked WHERE k <= 5 AND miles <= 900), rep AS (SELECT station, 'temp' AS grp FROM stations WHERE temp IS NOT NULL UNION ALL SELECT station, 'rain' FROM stations WHERE rain IS NOT NULL),
  have AS (SELECT place, grp, count(*) AS n FROM near JOIN rep USING (station) GROUP BY ALL),
  short AS (SELECT DISTINCT w.place FROM (SELECT DISTINCT place, g.grp FROM near, (VALUES ('temp'), ('rain')) g(grp)) w LEFT JOIN have h ON h.place = w.place AND h.grp = w.grp WHERE coalesce(n, 0) < 3),
  pool AS (SELECT place, station, miles FROM near UNION SELECT place, station, miles FROM ranked WHERE k <= 12 AND miles <= 900 AND place IN (SELECT place FROM short))""",
  select=f"""SELECT place, grp AS "group", station, {rs('miles')} AS miles FROM (SELECT *, row_number() OVER (PARTITION BY place, grp ORDER BY round(miles, 9), station) AS q FROM pool JOIN rep USING (station)) WHERE q <= 3"""))
def nearest_reporting_stations(t):
    links = _links(t)
    return links.select("place", "group", "station", r("miles").alias("miles"))


@shared
def _links(t):
    s = stations(t)
    reports = s.filter(F.col("temp").isNotNull()).select("station", F.lit("temp").alias("group")).unionByName(
        s.filter(F.col("rain").isNotNull()).select("station", F.lit("rain").alias("group")))
    return spatial.nearest_with_widening(base.places(t), "place", s.select("station", "lat", "lon"), "station", reports, "group", 3, 5, 12, 900)


THREE = "n3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY round(miles, 9), station) AS k FROM pairs) WHERE k <= 3)"


@query("D1 D3", with_(*NEAR, THREE, select=f"""SELECT place, {rs('sum(temp / (miles + 1)) / sum(CASE WHEN temp IS NOT NULL THEN 1 / (miles + 1) END)')} AS temp,
   {rs('sum(rain / (miles + 1)) / sum(CASE WHEN rain IS NOT NULL THEN 1 / (miles + 1) END)')} AS rain, arg_min(station, k) AS first_source, {rs('min(miles)')} AS first_miles,
   count(*) AS source_count FROM n3 GROUP BY 1"""))
def inverse_distance_means(t):
    n = spatial.nearest(base.places(t), "place", stations(t).select("station", "lat", "lon"), "station", 3)
    links = n.select("place", F.col("s_station").alias("station"), "miles")
    means = spatial.inverse_distance_mean(links, stations(t).select("station", "temp", "rain"), "station", ["place"], ["temp", "rain"])
    out = means.join(spatial.provenance(links, "place", "station"), "place")
    return out.select("place", r("temp").alias("temp"), r("rain").alias("rain"), "first_source", r("first_miles").alias("first_miles"), "source_count")


@query("C13", with_(*NEAR, select="SELECT place, min(miles) <= 40 AS within FROM pairs GROUP BY 1"))
def within_radius(t):
    return spatial.within_any(base.places(t).select("place", "lat", "lon"), "place", stations(t), 40.0).select("place", "within")


CENTERS = """ctr AS (SELECT county, degrees(atan2(z, sqrt(x * x + y * y))) AS lat, degrees(atan2(y, x)) AS lon FROM (SELECT county, sum(population * cos(radians(lat)) * cos(radians(lon))) AS x,
   sum(population * cos(radians(lat)) * sin(radians(lon))) AS y, sum(population * sin(radians(lat))) AS z FROM places GROUP BY 1))"""


@query("C14", with_(*base.PLACE_SQL, STATIONS, CENTERS, f"cp AS (SELECT county, station, {hav('c', 's')} AS miles FROM ctr c CROSS JOIN stations s)",
  select="SELECT county, station, round(1.609344 * miles, 1) AS km FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY round(miles, 9), station) AS k FROM cp) WHERE k = 1"))
def nearest_monitor_to_center(t):
    from ..functions.geo import KM_PER_MILE
    from ..operators.exposure import sphere_centers

    c = sphere_centers(base.places(t), ["county"], "population")
    n = spatial.nearest(c, "county", stations(t), "station", 1)
    return n.select("county", F.col("s_station").alias("station"), F.round(KM_PER_MILE * F.col("miles"), 1).alias("km"))


# Eight-sided zones around all stations, with a square hole.
OUTER = [(0.0, 1.5), (1.0, 1.125), (1.5, 0.0), (1.125, -1.0), (0.0, -1.5), (-1.0, -1.125), (-1.5, 0.0), (-1.125, 1.0)]
HOLE = [(0.25, 0.25), (0.25, -0.25), (-0.25, -0.25), (-0.25, 0.25)]


def zones(t):
    ring = lambda pts: F.array(*[F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat")) for dx, dy in pts])
    return stations(t).select(F.col("station").alias("zone"), "district", F.array(ring(OUTER), ring(HOLE)).alias("rings"))


ZONES = "zone AS (SELECT station AS zone, district, lat, lon FROM stations), edge AS (" + " UNION ALL ".join(
    f"SELECT zone, district, lon + {a[0]}::DOUBLE AS x1, lat + {a[1]}::DOUBLE AS y1, lon + {b[0]}::DOUBLE AS x2, lat + {b[1]}::DOUBLE AS y2 FROM zone"
    for ring in (OUTER, HOLE) for a, b in zip(ring, ring[1:] + ring[:1])) + """),
 hit AS (SELECT place, zone, district FROM places CROSS JOIN edge WHERE (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)
   GROUP BY place, zone, district HAVING count(*) % 2 = 1)"""


@query("C10", with_(*base.PLACE_SQL, STATIONS, ZONES, select="SELECT p.place, min(h.zone) AS zone, arg_min(h.district, h.zone) AS district FROM places p LEFT JOIN hit h USING (place) GROUP BY 1"))
def point_in_polygon(t):
    found = spatial.locate(base.places(t).select("place", "lat", "lon"), "place", zones(t), "zone", ["zone", "district"], 2.0)
    return found.select("place", "zone", "district")


@query("C11", with_(*base.PLACE_SQL, STATIONS, ZONES, """pc AS (SELECT place, lat, lon, zone, cos(radians(lat)) AS c, x1, y1, x2, y2 FROM places CROSS JOIN edge),
  pf AS (SELECT *, greatest(0.0, least(1.0, ((lon - x1) * c * (x2 - x1) * c + (lat - y1) * (y2 - y1)) / (pow((x2 - x1) * c, 2) + pow(y2 - y1, 2)))) AS f FROM pc)""",
  f"pm AS (SELECT place, zone, d2, {hav('a', 'b')} AS miles FROM (SELECT place, zone, pow((lon - x1 - (x2 - x1) * f) * c, 2) + pow(lat - y1 - (y2 - y1) * f, 2) AS d2, {{'lat': lat, 'lon': lon}} AS a, {{'lat': y1 + (y2 - y1) * f, 'lon': x1 + (x2 - x1) * f}} AS b FROM pf))",
  select=f"SELECT p.place, {rs('CASE WHEN h.place IS NOT NULL THEN 0 ELSE m END', 4)} AS miles FROM (SELECT place, arg_min(miles, d2) AS m FROM pm GROUP BY 1) p LEFT JOIN (SELECT DISTINCT place FROM hit) h USING (place)"))
def distance_to_edges(t):
    e = spatial.nearest_edge(base.places(t).select("place", "lat", "lon"), "place", zones(t), "zone", 10.0, 2.0)
    return e.select("place", r("miles", 4).alias("miles"))


@query("C12", with_(*base.PLACE_SQL, STATIONS, ZONES, """inz AS (SELECT p.place, p.spend, min(h.zone) AS zone, arg_min(h.district, h.zone) AS district FROM places p JOIN hit h USING (place) GROUP BY ALL)""",
  select="SELECT district, place FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY spend DESC NULLS LAST, place) AS k FROM inz) WHERE k = 1"))
def largest_member_per_group(t):
    from ..operators.rank import first_per_group

    found = spatial.locate(base.places(t).select("place", "lat", "lon", "spend"), "place", zones(t), "zone", ["zone", "district"], 2.0)
    best = first_per_group(found.filter(F.col("district").isNotNull()), ["district"], [F.desc_nulls_last("spend"), F.asc("place")])
    return best.select("district", "place")


@query("C26", with_(*NEAR, "g AS (SELECT * FROM stations WHERE district % 2 = 0 AND station % 3 = 0)", f"gp AS (SELECT place, county, g.station, {hav('p', 'g')} AS miles FROM places p CROSS JOIN g)",
  select=f"""SELECT place, county AS assigned, 0.0::DOUBLE AS miles FROM places WHERE county IN (SELECT station FROM g)
   UNION ALL SELECT place, station, {rs('miles')} FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY round(miles, 9), station) AS k FROM gp WHERE county NOT IN (SELECT station FROM g)) WHERE k = 1"""))
def own_or_nearest_group(t):
    groups = stations(t).filter("district % 2 = 0 AND station % 3 = 0").select("station", "lat", "lon")
    a = spatial.own_or_nearest(base.places(t).select("place", "county", "lat", "lon"), "place", "county", groups, "station")
    return a.select("place", "assigned", r("miles").alias("miles"))


SCHOOLS = """sch AS (SELECT p_partkey AS school, p_partkey % 25 AS district, CASE p_partkey % 3 WHEN 0 THEN 'elementary' WHEN 1 THEN 'middle' ELSE 'high' END AS level,
   25 + (p_partkey * 41 % 2500) / 100.0::DOUBLE AS lat, -125 + (p_partkey * 67 % 5800) / 100.0::DOUBLE AS lon, p_retailprice AS score FROM part)"""
PICKS = {"elementary": 3, "middle": 2, "high": 2}


@shared
def schools(t):
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("school"), (k % 25).alias("county"), F.when(k % 3 == 0, "elementary").when(k % 3 == 1, "middle").otherwise("high").alias("level"),
        (25 + (k * 41 % 2500) / 100.0).alias("lat"), (-125 + (k * 67 % 5800) / 100.0).alias("lon"), F.col("p_retailprice").alias("score"))


@query("C19", with_(*base.PLACE_SQL, SCHOOLS, f"""sp AS (SELECT place, county, school, level, score, {hav('p', 's')} AS miles FROM places p JOIN sch s ON s.district = p.county),
  pk AS (SELECT *, row_number() OVER (PARTITION BY place, level ORDER BY round(miles, 9), school) AS k FROM sp)""",
  select=f"""SELECT place, coalesce(string_agg(school::VARCHAR, ';' ORDER BY level, k) FILTER (WHERE level <> 'high'), '') AS nearby, {rs("avg(score) FILTER (WHERE level <> 'high')")} AS nearby_score,
   coalesce(string_agg(school::VARCHAR, ';' ORDER BY k) FILTER (WHERE level = 'high'), '') AS nearby_high FROM pk WHERE k <= CASE level WHEN 'elementary' THEN 3 ELSE 2 END GROUP BY 1"""))
def schools_in_district(t):
    near = spatial.in_group_nearest(base.places(t).select("place", "county", "lat", "lon"), "place", schools(t), "school", "county", "level", PICKS)
    high = F.col("level") == "high"
    keep = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(
        "level", "position", F.col("s_school").cast("string").alias("s"))))), lambda x: x["s"]), ";")
    out = near.groupBy("place").agg(keep(~high).alias("nearby"), F.avg(F.when(~high, F.col("s_score"))).alias("nearby_score"), keep(high).alias("nearby_high"))
    return out.select("place", "nearby", r("nearby_score").alias("nearby_score"), "nearby_high")


@query("C19 C20 D45", with_(*base.PLACE_SQL, SCHOOLS, f"""sp AS (SELECT place, county, school, level, score, {hav('p', 's')} AS miles FROM places p JOIN sch s ON s.district = p.county WHERE level <> 'high'),
  pk AS (SELECT *, row_number() OVER (PARTITION BY place, level ORDER BY round(miles, 9), school) AS k FROM sp),
  nv AS (SELECT place, round(avg(score), 6) AS s FROM pk WHERE k <= CASE level WHEN 'elementary' THEN 3 ELSE 2 END GROUP BY 1),
  own AS (SELECT district, count(*) AS n FROM sch WHERE level <> 'high' GROUP BY 1),
  curve AS (SELECT district, round(avg(score), 6) AS s FROM sch GROUP BY 1), dp AS (SELECT c.district, 100.0::DOUBLE * (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2) / count(*) OVER () AS pctl FROM curve c)""",
  select=f"""SELECT p.place, CASE WHEN nv.s IS NOT NULL AND (own.n >= 20 OR pctl IS NULL) THEN 'nearby' WHEN pctl IS NOT NULL THEN 'district' END AS basis,
   {rs('CASE WHEN nv.s IS NOT NULL AND (own.n >= 20 OR pctl IS NULL) THEN 100.0::DOUBLE * (SELECT count(*) FROM curve c WHERE c.s <= nv.s) / (SELECT count(*) FROM curve) ELSE pctl END')} AS pctl
   FROM places p LEFT JOIN nv USING (place) LEFT JOIN own ON own.district = p.county LEFT JOIN dp ON dp.district = p.county"""))
def school_score_by_area(t):
    from ..operators.rank import average_rank_percentile, share_at_or_below

    sch = schools(t)
    lower = {"elementary": 3, "middle": 2}
    near = spatial.in_group_nearest(base.places(t).select("place", "county", "lat", "lon"), "place", sch, "school", "county", "level", lower)
    mean = near.groupBy("place").agg(r(F.avg("s_score")).alias("s"))
    curve = sch.groupBy("county").agg(r(F.avg("score")).alias("s"))
    placed = share_at_or_below(mean, "s", curve, "s", "by_nearby")
    districts = average_rank_percentile(curve, ["county"], [], "s", "district_pctl").select("county", "district_pctl")
    count = sch.filter(F.col("level") != "high").groupBy("county").agg(F.count("*").alias("n"))
    rows = base.places(t).select("place", "county").join(placed, "place", "left").join(districts, "county", "left").join(count, "county", "left")
    use = F.col("s").isNotNull() & ((F.col("n") >= 20) | F.col("district_pctl").isNull())
    return rows.select("place", F.when(use, "nearby").when(F.col("district_pctl").isNotNull(), "district").alias("basis"),
                       r(F.when(use, F.col("by_nearby")).otherwise(F.col("district_pctl"))).alias("pctl"))


@query("D31", with_(*NEAR, f"""live AS (SELECT place, lat, lon, orders::DOUBLE AS w FROM places WHERE orders > 0), c AS (SELECT station, place FROM pairs JOIN live USING (place) WHERE miles <= 150),
  sm AS (SELECT a.place, sum(b.w) AS w, sum(b.w * b.lat) AS wl, sum(b.w * b.lon) AS wo FROM live a CROSS JOIN live b WHERE {hav('a', 'b')} <= 60 GROUP BY 1),
  b AS (SELECT station, w, wl, wo, row_number() OVER (PARTITION BY station ORDER BY w DESC, place) AS k FROM c JOIN sm USING (place))""",
  select=f"SELECT s.station, {rs('coalesce(wl / w, lat)')} AS lat, {rs('coalesce(wo / w, lon)')} AS lon, coalesce(w, 0) AS weight_within FROM stations s LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (station)"))
def densest_cluster_near(t):
    live = base.places(t).select("place", "lat", "lon", "orders")
    d = spatial.densest_clusters(stations(t), "station", live, "place", "orders", 150.0, 60.0)
    return d.select("station", r("lat").alias("lat"), r("lon").alias("lon"), "weight_within")


@query("B30", with_(*base.PLACE_SQL, STATIONS, CENTERS, select=f"""SELECT n_nationkey::BIGINT AS county, {rs('CASE WHEN n_nationkey % 4 <> 0 THEN c.lat ELSE 30 + n_nationkey END')} AS lat,
  {rs('CASE WHEN n_nationkey % 4 <> 0 THEN c.lon ELSE -100 + n_nationkey END')} AS lon, CASE WHEN n_nationkey % 4 <> 0 AND c.lat IS NOT NULL THEN 'population' ELSE 'internal' END AS point_source
  FROM nation LEFT JOIN ctr c ON c.county = n_nationkey"""))
def search_origins(t):
    from ..operators.exposure import sphere_centers

    k = F.col("n_nationkey").cast("long")
    rows = t.nation.select(k.alias("county"), (30.0 + k).alias("lat"), (-100.0 + k).alias("lon"))
    c = sphere_centers(base.places(t), ["county"], "population").filter("county % 4 <> 0")
    s = spatial.search_points(rows, c, "county")
    return s.select("county", r("lat").alias("lat"), r("lon").alias("lon"), "point_source")


@query("A20", with_(STATIONS, select=f"""SELECT station, lon < -50 AND lat > 10 AND lat < 75 AND NOT (lat > 49.5 AND lon > -129) AND NOT (lat > 44 AND lon > -80 AND lon < -71.3) AS kept FROM stations"""))
def coast_vertices(t):
    return stations(t).select("station", spatial.coast_vertex().alias("kept"))
