"""Refresh keeps what is live when a source breaks; checks find the faults put in; upserts repeat safely."""

import pytest
from pyspark.sql import functions as F

from terrarank.functions.flags import read_flags
from terrarank.operators import climate, crime, exposure, facts, joins, places, quality, refresh, schools
from terrarank.session import Limits


def test_source_down_or_collapsed_keeps_the_live_table(spark):
    live = spark.range(100).select(F.col("id"), (F.col("id") % 4).alias("st"), F.lit(1.0).alias("v"))
    scope = spark.createDataFrame([(1,), (2,)], "st long")
    fresh = live.filter("st IN (1, 2)").withColumn("v", F.lit(2.0))
    good = refresh.carry_over(fresh, live, "st", "v", scope)
    assert not good.carried and good.table.agg(F.sum("v")).first()[0] == 150 and good.table.count() == 100
    bad = refresh.carry_over(fresh.withColumn("v", F.when(F.col("id") % 10 > 0, F.col("v"))), live, "st", "v", scope)
    assert bad.carried and bad.table.agg(F.sum("v")).first()[0] == 100
    assert refresh.carry_over(None, live, "st", "v", scope).carried
    with pytest.raises(ValueError):
        refresh.carry_over(None, None, "st", "v", scope)


def test_overwrite_replaces_only_its_partitions(spark, tmp_path):
    df = spark.range(8).select("id", (F.col("id") % 2).alias("p"), F.lit("old").alias("v"))
    refresh.overwrite_partitions(df, str(tmp_path / "t"), ["p"])
    refresh.overwrite_partitions(df.filter("p = 1").withColumn("v", F.lit("new")), str(tmp_path / "t"), ["p"])
    assert {(r["p"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).select("p", "v").distinct().collect()} == {(0, "old"), (1, "new")}


def test_upsert_is_repeatable_and_logs_only_real_changes(spark):
    cols = "law string, state string, value string, status string, notes string"
    rows = spark.createDataFrame([("wage", "TX", "5.00", "in_effect", ""), ("wage", "*", "", "", ""), ("tax", "TX", "1", "in_effect", "")], cols)
    states = spark.createDataFrame([("TX",), ("UT",), ("NY",)], "state string")
    fresh = spark.createDataFrame([("TX", "5"), ("NY", "9")], "state string, value string")
    why = spark.createDataFrame([("UT", "sources disagree")], "state string, note string")
    new, log = facts.upsert(rows, states, fresh, "wage", why)
    assert {(r["state"], r["before"], r["after"]) for r in log.collect()} == {("NY", "", "9")}
    got = {(r["law"], r["state"]): (r["value"], r["notes"]) for r in new.collect()}
    assert got == {("tax", "TX"): ("1", ""), ("wage", "TX"): ("5", ""), ("wage", "NY"): ("9", ""), ("wage", "UT"): ("", "sources disagree")}
    again, log2 = facts.upsert(new, states, fresh, "wage", why)
    assert log2.count() == 0 and again.exceptAll(new).count() == 0


def test_lost_leading_zero_is_found(spark):
    df = spark.range(400).select(F.lpad((F.col("id") * 25).cast("string"), 5, "0").alias("fips"), (F.col("id") % 51).alias("state"), F.lit(1.0).alias("v"))
    broken = df.withColumn("v", F.when(F.col("fips") >= "01000", F.col("v")))
    low = F.col("fips") < "01000"
    assert "FAIL" in {r["severity"] for r in quality.join_rates(broken.unionByName(df.limit(0)), {"src": "v"}, low).collect()}
    short = df.withColumn("fips", F.regexp_replace("fips", "^0", ""))
    assert {r["key"] for r in quality.key_integrity(short, "fips", 5, low, 0, "state", 50).collect()} >= {"width"}
    assert not quality.stops(quality.key_integrity(df, "fips", 5, low, 10, "state", 50))


def test_source_that_joins_nothing_fails(spark):
    df = spark.range(50).select("id", F.lit(None).cast("double").alias("v"))
    assert quality.stops(quality.join_rates(df, {"src": "v"}, F.col("id") < 10))


def test_duplicate_key_fails_before_it_fans_out(spark):
    spine = spark.createDataFrame([(1,), (2,)], "k int")
    source = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, v double")
    with pytest.raises(Exception, match="duplicate key"):
        joins.join_sources(spine, "k", {"s": source}).collect()


def test_exposure_under_half_coverage_is_unknown(spark):
    df = spark.createDataFrame([("a", 49, 5.0), ("a", 51, None), ("b", 50, 5.0), ("b", 50, None), ("c", 10, None)], "t string, pop int, value double")
    got = {r["t"]: (r["x"], r["x_max"], r["x_coverage"], r["x_above"]) for r in exposure.weighted_exposure(df, ["t"], "x", benchmark=4.0).collect()}
    assert got == {"a": (None, None, 49.0, None), "b": (5.0, 5.0, 50.0, 100.0), "c": (None, None, 0.0, None)}


def test_climate_types(spark):
    def year(name, temps, rain):
        return [(name, m + 1, t, t, r) for m, (t, r) in enumerate(zip(temps, rain))]
    hot = [86.0] * 12
    rows = (year("Af", hot, [5.0] * 12) + year("BWh", hot, [0.05] * 12) + year("ET", [20, 20, 25, 30, 35, 40, 45, 40, 35, 30, 25, 20], [2.0] * 12)
            + year("Csa", [50, 52, 55, 60, 66, 72, 78, 78, 73, 65, 57, 51], [5, 4, 3, 2, 0.5, 0.1, 0.0, 0.1, 0.4, 1.5, 3, 5])
            + year("short", hot, [5.0] * 12)[:11])
    df = spark.createDataFrame([(a, b, float(c), float(d), float(e)) for a, b, c, d, e in rows], "fips string, month int, tmax_f double, tmin_f double, precip_in double")
    got = {r["fips"]: r["koppen"] for r in climate.types(df, "fips").collect()}
    assert got == {"Af": "Af", "BWh": "BWh", "ET": "ET", "Csa": "Csa"}


def test_borderline_type(spark):
    # The coldest month sits just above freezing: half a degree colder turns C into D.
    temps = [32.2, 36, 45, 55, 65, 74, 79, 77, 70, 58, 46, 36]
    df = spark.createDataFrame([("x", m + 1, float(t), float(t), 3.5) for m, t in enumerate(temps)], "fips string, month int, tmax_f double, tmin_f double, precip_in double")
    r = climate.types(df, "fips").first()
    assert (r["koppen"], r["koppen_alt"]) == ("Cfa", "Dfa")


def test_climate_filter_words(spark):
    present = spark.createDataFrame([("Cfa",), ("Dfa",), ("BWh",), ("Aw",), ("BSk",), ("BSh",)], "koppen string")
    accepts = spark.createDataFrame([("a", ["Cfa", "Dfa", "BSk", "BSh"]), ("b", ["Cfa", "Dfa", "BWh", "Aw", "BSk"]), ("c", ["Cfa"])], "search string, accept array<string>")
    got = {r["search"]: r["text"] for r in climate.describe_filter(accepts, present).collect()}
    assert got == {"a": "not Desert or Tropical", "b": "not all of Dry & sunny", "c": "only Humid South"}


def test_partial_years_are_annualized_once(spark):
    df = spark.createDataFrame([(1, 60000.0, 6, 50.0, 500.0), (2, 60000.0, 2, 50.0, 500.0)], "k int, pop double, months int, v double, p double")
    note = crime.rate_note("pop", "months", "v", "p")
    once = refresh.annualize_once(df, ["v", "p"], "months", note)
    again = refresh.annualize_once(once, ["v", "p"], "months", note)
    assert [(r["v"], r["crime_note"]) for r in again.orderBy("k").collect()] == [(100.0, None), (None, "months")]


def test_enrollment_codes(spark):
    df = spark.createDataFrame([(5, -9, 2), (-9, -9, -9), (0, -3, -9)], "m int, f int, x int")
    assert [r[0] for r in df.select(schools.reported_total(["m", "f", "x"])).collect()] == [7.0, None, 0.0]


def test_fill_labels_in_slices(spark):
    df = spark.createDataFrame([("s", i, f"L{i}" if i % 9 == 4 else None) for i in range(60)], "sheet string, row int, label string")
    for limits in (Limits(), Limits(slices=5)):
        got = {r["row"]: r["block"] for r in facts.fill_labels(df, ["sheet"], "row", "label", "block", limits).collect()}
        assert all(got[i] == (None if i < 4 else f"L{(i - 4) // 9 * 9 + 4}") for i in range(60))


def test_place_lookup(spark):
    counties = spark.createDataFrame([(1, "Travis County", "TX", 1000.0), (2, "Orleans Parish", "LA", 500.0)], "county long, county_name string, state string, population double")
    areas = spark.createDataFrame(
        [(1, 1, "Zilker, Austin · 78704", 50, 30.2, -97.7), (2, 1, "Austin · 78701", 70, 30.3, -97.7), (3, 1, "Near Austin · 78653", 10, 30.4, -97.5), (4, 2, "Austin · 70112", 5, 29.9, -90.0),
         (5, 2, "Near Saint Rose · 70112", 9, None, None)], "area long, county long, label string, population int, lat double, lon double")
    index = places.place_index(areas, counties)
    rows = {(r["kind"], r["name"], r["state"]): r for r in index.collect()}
    austin = rows["city", "Austin", "TX"]
    assert (austin["population"], austin["areas"], austin["near"], austin["where"]) == (120.0, 2, False, "Travis County, TX")
    assert rows["city", "Saint Rose", "LA"]["near"] is True
    asked = spark.createDataFrame([("a", "austin tx"), ("b", "zilk"), ("c", "travis"), ("d", "st rose"), ("e", "a"), ("f", "austin ny"), ("g", "zilker austin")], "query_id string, text string")
    got = {}
    for r in places.search_places(index, asked).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((r["kind"], r["name"], r["state"], r["quality"]))
    assert got["a"][0] == ("city", "Austin", "TX", 3)
    assert got["b"] == [("neighborhood", "Zilker", "TX", 2)]
    assert got["c"] == [("county", "Travis County", "TX", 3)]
    assert got["d"] == [("city", "Saint Rose", "LA", 3)]
    assert "e" not in got and "f" not in got and got["g"][0][1] == "Zilker"


def test_flags_read_and_moved(spark):
    df = spark.createDataFrame([(1, "a;b", 9500.0)], "k int, f string, v double").withColumns({"low_confidence": read_flags("f"), "topcoded": F.array().cast("array<string>")})
    out = refresh.move_topcodes(df.withColumnRenamed("v", "a"), {"a": 9000}).first()
    assert out["low_confidence"] == ["b"] and out["topcoded"] == ["a"]


def test_text_profile_shows_first_known_values(spark):
    rows = [(k, None if k % 3 == 0 else f"v{k}", None) for k in range(9, 0, -1)]
    got = {r["column"]: r for r in quality.text_profile(spark.createDataFrame(rows, "k long, a string, b string"), "k", ["a", "b"]).collect()}
    assert (got["a"].nulls, got["a"].rows, got["a"].samples) == (3, 9, ["v1", "v2", "v4"])
    assert (got["b"].nulls, got["b"].samples) == (9, [])


def test_rows_meet_one_candidate_of_each_name(spark):
    table = spark.range(2_000).select((F.col("id") % 2).alias("nm"), (5_000 - F.col("id")).alias("agency"), (F.col("id") % 7).alias("worth"))
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 9), (4, None)], "area long, nm long")
    found = joins.candidate_match(rows, "area", [("name", table, ["nm"])], "agency", ["worth"])
    assert {r["area"]: (r["agency"], r["matched_by"]) for r in found.collect()} == {
        1: (3_012, "name"), 2: (3_005, "name"), 3: (None, None), 4: (None, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Join Inner")[1]
    assert below.index("min(struct(worth") < below.index("Range"), "candidates are narrowed below the join"
