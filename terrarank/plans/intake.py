"""File layouts: text, JSON and records derived from the tables, read back by the source operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import number
from ..session import durable, shared_folder
from ..sources import codes, files, periods, publish
from . import base
from .registry import query, r, rs, with_


@query("A1 A2", """SELECT lpad(s_suppkey::VARCHAR, 5, '0') AS fips, 'Doña ' || s_name AS name, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS balance FROM supplier""")
def delimited_scan(t):
    """Tab-separated files with padded headers and a dirty number, half of them UTF-8 and half Latin-1, written and read back as text."""
    k = F.col("s_suppkey")
    text = t.supplier.select(k, F.lpad(k.cast("string"), 5, "0").alias("fips"), F.concat(F.lit("Doña "), "s_name").alias(" name "),
                             F.when(k % 7 == 0, "(X)").otherwise(F.col("s_acctbal").cast("string")).alias("balance "))
    folder = shared_folder(t.spark)
    for part, encoding in enumerate(("UTF-8", "ISO-8859-1")):
        text.filter(k % 2 == part).drop("s_suppkey").write.csv(f"{folder}/{part}", sep="\t", header=True, encoding=encoding)
    df = files.read_delimited(t.spark, f"{folder}/*", "\t", ["fips", "name", "balance"])
    return files.cast_columns(df, {"balance": "double"}).select("fips", "name", "balance")


@query("A2", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Doña Ana' ELSE 'Peña' END || c_custkey AS name, c_custkey % 5 = 0 AS mojibake FROM customer")
def decoded_text(t):
    from ..functions.text import is_mojibake

    k = F.col("c_custkey")
    word = F.concat(F.when(k % 2 == 0, "Doña Ana").otherwise("Peña"), k.cast("string"))
    raw = F.when(k % 2 == 0, F.encode(F.concat(F.lit("﻿"), word), "UTF-8")).otherwise(F.encode(word, "ISO-8859-1"))
    bad = F.when(k % 5 == 0, F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")).otherwise(word)
    return t.customer.select(k, files.decode_bytes(raw).alias("name"), is_mojibake(bad).alias("mojibake"))


@query("A3 H16", "SELECT l_orderkey || '-' || l_linenumber AS block, l_quantity::BIGINT AS pop FROM lineitem WHERE l_linenumber % 2 = 1")
def record_lines(t):
    n = F.col("l_linenumber")
    line = F.concat_ws("|", F.lit("PL"), F.when(n % 2 == 1, "750").otherwise("140"), F.concat_ws("-", "l_orderkey", n), F.col("l_quantity").cast("long").cast("string"), F.lit(""))
    lines = t.lineitem.select(line.alias("line"))
    out = files.record_lines(lines, "line", "|", 1, "750", {"block": 2, "pop": 3}, 5)
    return out.select("block", F.col("pop").cast("long"))


@query("A4", "SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def array_json(t):
    """One JSON page of rows per customer, in two column chunks joined on the key."""
    def pages(*cols):
        row = F.array(*[F.col(c).cast("string") for c in cols])
        g = t.orders.groupBy("o_custkey").agg(F.collect_list(row).alias("r"))
        return g.select(F.to_json(F.concat(F.array(F.array(*[F.lit(c) for c in cols])), "r")).alias("body"))
    a = files.array_table(pages("o_orderstatus", "o_orderkey"), "body", ["o_orderkey", "o_orderstatus"])
    b = files.array_table(pages("o_orderkey", "o_totalprice"), "body", ["o_orderkey", "o_totalprice"])
    j = files.join_chunks([a, b], ["o_orderkey"])
    return j.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), number("o_totalprice").alias("price"))


@query("A5", "SELECT lpad(s_suppkey::VARCHAR, 5, '0') AS key, 2023::BIGINT AS year, s_acctbal AS value FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT lpad(s_suppkey::VARCHAR, 5, '0'), 2024, s_suppkey::DOUBLE FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0")
def series_json(t):
    k = F.col("s_suppkey")
    sid = F.concat(F.when(k % 3 == 0, "LAUST").otherwise("LAUCN"), F.lpad(k.cast("string"), 5, "0"), F.lit("0000000003"))
    point = lambda y, p, v: F.struct(F.lit(y).alias("year"), F.lit(p).alias("period"), v.alias("value"))
    data = F.array(point("2023", "M13", F.col("s_acctbal").cast("string")), point("2023", "M01", F.lit("9.9")),
                   point("2024", "M13", F.when(k % 5 == 0, "-").otherwise(k.cast("string"))))
    body = F.to_json(F.struct(F.array(F.struct(sid.alias("seriesID"), data.alias("data"))).alias("series")))
    out = files.annual_series(t.supplier.select(body.alias("body")), "body", "LAUCN", 20, 6, 5)
    return out.select("key", F.col("year").cast("long"), "value")


@query("A6 A13", "SELECT c_nationkey::VARCHAR || '-' || c_custkey AS id, c_mktsegment AS segment, CASE WHEN c_custkey % 6 <> 0 THEN round_even(c_acctbal, 1) END AS balance, NULL::DOUBLE AS absent FROM customer")
def row_payloads(t):
    k = F.col("c_custkey")
    rows = t.customer.select("c_nationkey", F.concat_ws("-", F.col("c_nationkey").cast("string"), k.cast("string")).alias("id"), F.col("c_mktsegment").alias("segment"),
                             F.when(k % 6 != 0, F.col("c_acctbal")).alias("balance"), F.lit("x").alias("nri_version"))
    small = publish.compact(rows, {"balance": 1})
    bodies = files.payload_of(small, "rows-v1", ["c_nationkey"])
    return files.row_payload(bodies, "body", "rows-v1", ["id", "segment"], ["balance", "absent"])


@query("A6", "SELECT c_custkey::VARCHAR AS geoid, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS balance FROM customer")
def column_payloads(t):
    k = F.col("c_custkey")
    g = t.customer.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), F.when(k % 6 != 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("b")))).alias("r"))
    part = lambda f: F.transform("r", lambda x: x[f].cast("string"))
    body = F.to_json(F.struct(F.lit("cols-v1").alias("format"), F.size("r").alias("n"), F.struct(part("k").alias("geoid"), part("b").alias("balance")).alias("columns")))
    return files.column_payload(g.select(body.alias("body")), "body", "cols-v1", ["geoid"], ["balance"])


WIDE = """m AS (SELECT l_suppkey AS zip, strftime(l_shipdate, '%Y-%m') AS month, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
 c AS (SELECT month, count(*) FILTER (WHERE month < (SELECT max(month) FROM m) OR zip % 3 = 0) AS n FROM m GROUP BY 1), l AS (SELECT max(month) AS latest FROM c WHERE n > 0.5 * (SELECT count(DISTINCT zip) FROM m))"""


@query("A8", with_(WIDE, select=f"""SELECT zip, max(v) FILTER (WHERE month = latest) AS value, {rs("100 * (max(v) FILTER (WHERE month = latest) / max(v) FILTER (WHERE month = strftime(strptime(latest || '-01', '%Y-%m-%d') - INTERVAL 12 MONTH, '%Y-%m')) - 1)")} AS value_yoy, max(latest) AS month
  FROM m, l WHERE month IN (latest, strftime(strptime(latest || '-01', '%Y-%m-%d') - INTERVAL 12 MONTH, '%Y-%m')) GROUP BY 1"""))
def latest_month_of_wide_table(t):
    """Month columns from ship dates; the last month is known for a third of the rows only, so it is passed over."""
    month = F.date_format("l_shipdate", "yyyy-MM")
    long = t.lineitem.groupBy(F.col("l_suppkey").alias("zip"), month.alias("month")).agg(F.sum("l_quantity").alias("v"))
    names = [row[0] for row in t.lineitem.select(month).distinct().sort(month).collect()]
    wide = long.groupBy("zip").pivot("month", names).agg(F.max("v"))
    wide = wide.withColumn(names[-1], F.when(F.col("zip") % 3 == 0, F.col(f"`{names[-1]}`")))
    out = periods.latest_month(wide, "zip", names, "value")
    return out.filter("value IS NOT NULL OR value_yoy IS NOT NULL OR month IS NOT NULL").select("zip", "value", r("value_yoy").alias("value_yoy"), "month")


@query("A12", "SELECT lpad(c_custkey::VARCHAR, 5, '0') AS fips, c_acctbal FROM customer")
def interim_tables(t):
    folder = shared_folder(t.spark)
    publish.write_interim(t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("fips"), "c_acctbal"), folder, "acs")
    return publish.read_interim(t.spark, folder, "acs", ["fips"])


@query("A14 G2", with_(*base.PLACE_SQL, select="SELECT county::BIGINT AS county, count(*) AS rows, '2026-01-01' AS generated, max(CASE WHEN county % 5 = 2 THEN 2 ELSE 1 END)::BIGINT AS edition FROM places GROUP BY 1"))
def published_partitions(t):
    """All partitions written, some rebuilt and overwritten alone, then indexed."""
    p = base.places(t).select("place", "county", F.lit(1).alias("edition"))
    folder = shared_folder(t.spark)
    publish.publish(p, folder, ["county"])
    publish.publish(p.filter("county % 5 = 2").withColumn("edition", F.lit(2)), folder, ["county"])
    back = t.spark.read.parquet(folder)
    index = publish.index_of(back, "county", "2026-01-01").join(back.groupBy("county").agg(F.max("edition").cast("long").alias("edition")), "county")
    return index.select(F.col("county").cast("long"), "rows", "generated", "edition")


@query("A16", "SELECT p_partkey, p_type AS word, dense_rank() OVER (ORDER BY p_type) - 1 AS code, p_type AS back FROM part")
def coded_words(t):
    table = durable(codes.code_table(t.part, "p_type"))
    coded = codes.encode_with(t.part.select("p_partkey", F.col("p_type").alias("text")), "text", table)
    return codes.decode_with(coded, "code", table, "back").select("p_partkey", F.col("text").alias("word"), "code", "back")


@query("A18 B5", """SELECT s_suppkey::VARCHAR AS station, m::BIGINT AS month, CASE WHEN m <> 3 THEN s_acctbal + m END AS tmax, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN m * 2.0::DOUBLE END AS prcp
  FROM supplier, (VALUES (1), (2), (3)) v(m) WHERE m <> 3 OR s_suppkey % 4 = 2""")
def station_rows(t):
    """A folder with files of three layouts: columns in another order, and one column that some files lack."""
    k, m = F.col("s_suppkey").cast("string"), F.col("m")
    rows = t.supplier.withColumn("m", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        "s_suppkey", k.alias("STATION"), F.concat(F.lit("2010-"), F.lpad(m.cast("string"), 2, "0")).alias("DATE"),
        F.when(m == 3, "-7777").otherwise((F.col("s_acctbal") + m).cast("string")).alias("TMAX"),
        F.when(F.col("s_suppkey") % 4 == 0, "-9999").otherwise((m * 2.0).cast("string")).alias("PRCP"), F.lit("a, b").alias("NAME"))
    folder = shared_folder(t.spark)
    for part, columns in enumerate((["STATION", "DATE", "TMAX", "PRCP"], ["NAME", "PRCP", "DATE", "STATION", "TMAX"], ["STATION", "NAME", "DATE", "TMAX"])):
        keep = F.col("s_suppkey") % 4 == part * 2 if part < 2 else F.col("s_suppkey") % 2 == 1
        rows.filter(keep).select(*columns).write.option("header", True).csv(f"{folder}/{part}")
    out = files.read_stations(t.spark, f"{folder}/*", ["TMAX", "PRCP"], [-7777, -9999])
    return out.withColumn("month", F.col("month").cast("long"))


@query("A18", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'USW' ELSE 'USC' END || lpad(s_suppkey::VARCHAR, 8, '0') AS station, 25.5::DOUBLE + s_suppkey % 20 AS lat, -100.25::DOUBLE + s_suppkey % 10 AS lon FROM supplier WHERE s_suppkey % 10 <> 3")
def station_inventory(t):
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 10 == 3, "USX").when(k % 2 == 0, "USW").otherwise("USC"), F.lpad(k.cast("string"), 8, "0"))
    lat, lon = (25.5 + k % 20).cast("string"), (-100.25 + k % 10).cast("string")
    line = F.when(k % 3 == 0, F.concat_ws(",", name, lat, lon, F.lit("x"))).otherwise(F.concat(name, F.lit(" "), F.lpad(lat, 8, " "), F.lit(" "), F.lpad(lon, 9, " "), F.lit(" 12.0 TX")))
    return files.station_inventory(t.supplier.select(line.alias("line")), "line", ["USX"])


@query("A19", "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'ID' || s_suppkey ELSE 'A' || s_suppkey END AS code, s_name AS name, 30.0::DOUBLE + s_suppkey % 10 AS lat, -90.0::DOUBLE AS lon FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0")
def large_airports(t):
    k = F.col("s_suppkey")
    a = t.supplier.select(
        F.when(k % 3 == 0, "large_airport").otherwise("heliport").alias("type"), F.lit("US").alias("iso_country"), F.when(k % 5 == 0, "no").otherwise("yes").alias("scheduled_service"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("A"), k.cast("string"))).alias("iata_code"), F.concat(F.lit("ID"), k.cast("string")).alias("ident"),
        F.col("s_name").alias("name"), (30.0 + k % 10).cast("string").alias("latitude_deg"), F.lit("-90.0").alias("longitude_deg"))
    return files.large_airports(a)


@query("A19", "SELECT c_name AS name, 'S' || c_nationkey AS state, 40.0::DOUBLE AS lat, -80.0::DOUBLE AS lon, c_acctbal * 4 AS population FROM customer WHERE c_acctbal * 4 >= 15000 AND c_custkey % 3 <> 0")
def large_towns(t):
    k = F.col("c_custkey")
    a = t.customer.select(F.lit("US").alias("country"), F.when(k % 3 == 0, "PPLX").otherwise("PPLA2").alias("fcode"), F.col("c_name").alias("name"),
                          F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("admin1"), F.lit("40.0").alias("lat"), F.lit("-80.0").alias("lon"), (F.col("c_acctbal") * 4).cast("string").alias("population"))
    return files.towns(a)


@query("A21", "SELECT o_orderkey AS block, 'Z' || o_custkey % 90 AS zcta FROM orders WHERE o_orderkey % 6 <> 0")
def block_membership(t):
    k = F.col("o_orderkey")
    z = F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit("Z"), (F.col("o_custkey") % 90).cast("string")))
    return files.membership(t.orders.select(k.alias("block"), z.alias("zcta")), "block", "zcta")


@query("A22", "SELECT n_nationkey AS county, 'all' AS plan FROM nation UNION ALL SELECT n_nationkey, 'published' FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def partitions_to_build(t):
    want = t.nation.select(F.col("n_nationkey").alias("county"))
    done = t.supplier.select(F.col("s_nationkey").alias("county")).distinct()
    return files.partitions_to_build(want, done, "county", False).withColumn("plan", F.lit("all")).unionByName(
        files.partitions_to_build(want, done, "county", True).withColumn("plan", F.lit("published")))


@query("B15 B16", f"""SELECT lpad((10000 + c_custkey)::VARCHAR, 5, '0') AS fips, {rs('avg(c_acctbal + g)')} AS achievement FROM customer, (VALUES (0), (1)) v(g) GROUP BY 1""")
def picked_columns_and_levels(t):
    """The column named like a key but holding state codes is rejected; one level is kept; grades averaged."""
    k = F.col("c_custkey")
    rows = t.customer.withColumn("g", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("s", F.explode(F.array(F.lit("All "), F.lit("wht")))).select(
        F.col("c_nationkey").cast("string").alias("FIPS"), F.lpad((10000 + k).cast("string"), 5, "0").alias("sedacounty"), F.col("s").alias("subgroup"), F.lit("0").alias("gap"),
        F.col("g").alias("grade"), F.when(F.col("s") == "wht", 0.0).otherwise(F.col("c_acctbal") + F.col("g")).cast("string").alias("cs"))
    key = files.pick_column(rows, ["fips", "sedacounty"], [4, 5])
    level = files.level_rows(rows, {"subgroup": "all", "gap": "0"})
    return files.average_over_axes(level.withColumnRenamed(key, "key"), "key", "cs", "achievement").select(F.col("key").alias("fips"), r("achievement").alias("achievement"))
