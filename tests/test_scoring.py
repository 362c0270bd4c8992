"""Scores: unknown weighs 50, must-haves never change points, areas and budgets."""

import math

import pytest
from pyspark.sql import functions as F

from terrarank.functions import points as P
from terrarank.functions.flags import read_flags
from terrarank.operators import area, score
from terrarank.operators.taxes import household_taxes, income_tax, parse_schedule


def criteria(spark, rows):
    return spark.createDataFrame([("s", *row) for row in rows], "search string, metric string, weight double, direction string")


def run(spark, places, asked, limits=None, accepts=None):
    df = spark.createDataFrame(places, "k int, a double, b double, c string")
    known = score.contributions(df, "k", asked, ["a", "b"])
    statuses = score.filter_results(df, "k", limits, accepts) if limits is not None or accepts is not None else score.all_match(df, "k", asked)
    out = score.scores(df, "k", asked, known, statuses)
    return {r["k"]: r for r in out.collect()}


PLACES = [(1, 10.0, 1.0, "x"), (2, 20.0, None, "y"), (3, 30.0, 3.0, None)]


def test_unknown_counts_fifty_at_full_weight(spark):
    got = run(spark, PLACES, criteria(spark, [("a", 1.0, "higher"), ("b", 3.0, "higher")]))
    assert got[2]["score"] == pytest.approx((50 + 3 * 50) / 4) and got[2]["missing"] == 1
    assert got[3]["score"] == pytest.approx(100.0)


def test_weights_are_clamped_and_zero_weights_leave_no_score(spark):
    got = run(spark, PLACES, criteria(spark, [("a", 50.0, "higher"), ("b", 5.0, "lower")]))
    assert got[1]["score"] == pytest.approx((5 * 0 + 5 * 100) / 10)
    none = run(spark, PLACES, criteria(spark, [("a", 0.0, "higher")]))
    assert all(r["score"] is None for r in none.values())


def test_middle_direction(spark):
    got = run(spark, PLACES, criteria(spark, [("a", 1.0, "middle")]))
    assert [got[k]["score"] for k in (1, 2, 3)] == [0.0, 100.0, 0.0]


def test_must_have_is_inclusive_and_three_valued_and_keeps_points(spark):
    limits = spark.createDataFrame([("s", "b", 1.0, 3.0)], "search string, metric string, min double, max double")
    free = run(spark, PLACES, criteria(spark, [("a", 1.0, "higher")]))
    got = run(spark, PLACES, criteria(spark, [("a", 1.0, "higher")]), limits)
    assert {k: r["status"] for k, r in got.items()} == {1: 0, 2: 1, 3: 0}
    assert {k: r["score"] for k, r in got.items()} == {k: r["score"] for k, r in free.items()}
    tight = spark.createDataFrame([("s", "b", None, 2.0)], "search string, metric string, min double, max double")
    assert run(spark, PLACES, criteria(spark, [("a", 1.0, "higher")]), tight)[3]["score"] is None


def test_empty_accept_list_rejects_every_known_value(spark):
    accepts = spark.createDataFrame([("s", "c", [])], "search string, category string, accept array<string>")
    got = run(spark, PLACES, criteria(spark, [("a", 1.0, "higher")]), None, accepts)
    assert {k: r["status"] for k, r in got.items()} == {1: 2, 2: 2, 3: 1}


def test_alternative_category_passes(spark):
    df = spark.createDataFrame([(1, "Cfa", "Dfa"), (2, "Cfa", None)], "k int, koppen string, alt string")
    accepts = spark.createDataFrame([("s", "koppen", ["Dfa"])], "search string, category string, accept array<string>")
    got = score.filter_results(df, "k", None, accepts, {"koppen": "alt"}).collect()
    assert {r["k"]: r["status"] for r in got} == {1: 0, 2: 2}


def test_rank_puts_matches_before_unknowns_then_key(spark):
    rows = [("s", 1, 1, 90.0), ("s", 2, 0, 10.0), ("s", 3, 0, None), ("s", 4, 0, 10.0), ("s", 5, 2, None)]
    df = spark.createDataFrame(rows, "search string, k int, status int, score double")
    assert [r["k"] for r in score.ranked(df, "k", 9).orderBy("position").collect()] == [2, 4, 3, 1]
    assert [r["k"] for r in score.ranked(df, "k", 9, include_unknown=False).orderBy("position").collect()] == [2, 4, 3]


def test_normal_cdf_and_banded_points(spark):
    zs = [-3.0, -0.5, 0.0, 0.7, 2.5]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(P.normal_cdf("z")).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(z / math.sqrt(2))) for z in zs], abs=2e-7)

    def expected(v):
        band = lambda x: 100 if x <= 5 else 75 if x <= 7 else 50 if x <= 9 else 25 if x <= 12 else 0
        grid = [-8 + i * 0.002 for i in range(8001)]
        w = [math.exp(-0.5 * z * z) for z in grid]
        return sum(wi * band(v + 1.7 * z) for wi, z in zip(w, grid)) / sum(w)

    rows = spark.createDataFrame([(4.0, False), (8.99, False), (9.01, False), (4.0, True), (None, False)], "v double, d boolean")
    got = [r[0] for r in rows.select(P.pm25_points("v", F.col("d"))).collect()]
    assert got[:3] == pytest.approx([expected(4.0), expected(8.99), expected(9.01)], abs=0.05)
    assert got[3] == 50.0 and got[4] is None


def test_budget_and_linear_points(spark):
    df = spark.createDataFrame([(200.0,), (250.0,), (300.0,), (None,)], "v double")
    got = [tuple(r) for r in df.select(P.budget_points("v", F.lit(200.0)), P.linear_points("v", 100, 300)).collect()]
    assert got == [(100.0, 50.0), (50.0, 25.0), (0.0, 0.0), (None, None)]


AREAS = "area int, county int, population double, group_quarters_share double, value double, value_eb double, flags string"


def areas(spark, rows):
    return spark.createDataFrame(rows, AREAS).withColumn("low_confidence", read_flags("flags"))


def test_nonresidential_areas_leave_the_distribution_and_estimates_rank(spark):
    df = areas(spark, [(1, 1, 500.0, 0.0, 10.0, None, ""), (2, 1, 500.0, None, 20.0, 5.0, ""), (3, 1, 50.0, 0.0, 99.0, None, ""), (4, 1, 900.0, 50.0, 98.0, None, ""),
                       (5, 1, 500.0, 0.0, None, 7.0, "")])
    asked = spark.createDataFrame([("s", "value", 1.0, "higher", None, 0)], "search string, metric string, weight double, direction string, budget double, position int")
    got = {r["area"]: r for r in area.area_parts(df, "area", asked, ["value"], {"value": "value_eb"}).collect()}
    assert got.keys() == {1, 2}
    assert got[1]["points"] == 100.0 and got[2]["points"] == 0.0
    assert got[2]["value"] == 20.0 and got[2]["scored"] == 5.0 and got[1]["scored"] is None


def test_county_gates_and_shared_part(spark):
    df = areas(spark, [(1, 1, 500.0, 0.0, 10.0, None, ""), (2, 2, 500.0, 0.0, 20.0, None, ""), (3, 9, 500.0, 0.0, 30.0, None, ""), (4, 3, 10.0, 0.0, 30.0, None, "")])
    asked = spark.createDataFrame([("s", "value", 1.0, "higher", None, 0)], "search string, metric string, weight double, direction string, budget double, position int")
    side = spark.createDataFrame([("s", 1, 0, 160.0, 2.0), ("s", 2, 2, 0.0, 2.0), ("s", 3, 0, 0.0, 2.0)],
                                 "search string, county int, county_status int, county_sum double, county_weight double")
    parts = area.area_parts(df, "area", asked, ["value"])
    got = {r["area"]: r for r in area.score_areas(df, "area", "county", asked, None, parts, side, ["value"]).collect()}
    assert got.keys() == {1, 2, 4}  # a county not in play is out
    assert got[1]["score"] == pytest.approx((160 + 0) / 3) and got[1]["status"] == 0
    assert got[2]["status"] == 2 and got[4]["status"] == 3 and got[4]["score"] is None


def test_brackets_deduction_credit_and_renter(spark):
    text = "s:0.02@0,0.04@10000;m:0.03@0;sd:1000,2000;ex:500,0;cr:10,0"
    df = spark.createDataFrame([(text, 20000.0, "single"), (text, 20000.0, "joint"), ("none", 5000.0, "single"), ("junk", 1.0, "single")], "t string, i double, f string")
    s = df.select(parse_schedule("t").alias("s"), "i", "f")
    got = [r[0] for r in s.select(income_tax(F.col("s"), F.col("i"), F.col("f"))).collect()]
    assert got[0] == pytest.approx(0.02 * 10000 + 0.04 * 8500 - 10) and got[1] == pytest.approx(0.03 * 18000) and got[2] == 0.0 and got[3] is None
    one = spark.createDataFrame([("rent",), ("buy",)], "tenure string").select("tenure", parse_schedule(F.lit("none")).alias("s"))
    null = F.lit(None).cast("double")
    cols = household_taxes(null, null, null, F.lit(8.0), F.col("s"), F.col("tenure"), F.lit(300000.0), F.lit(100000.0), F.lit("joint"))
    got = {r["tenure"]: r["taxes"] for r in one.select("tenure", cols["taxes"].alias("taxes")).collect()}
    assert got["rent"] == pytest.approx(0.08 * 0.25 * 100000) and got["buy"] is None


def test_status_counts_keep_zeros(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("b", 1, 2)], "search string, place long, status int")
    assert sorted(tuple(r) for r in score.status_counts(rows).collect()) == [("a", 2, 1, 0), ("b", 0, 0, 1)]
