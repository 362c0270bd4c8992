import numpy as np
from pyspark.sql import functions as F

from terrarank.operators import estimate, resample
from terrarank.plans import estimates


def test_replicates_are_independent_draws(spark):
    """Many groups of one population: their variances may scatter as 200 independent replicates do, about 10 in 100."""
    rows = spark.range(6000).select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(6_000_000)).alias("key"), (F.col("id") / 100).cast("int").alias("g"), (F.col("id") % 100).alias("i"))
    rows = rows.select("key", "g", F.pmod(F.xxhash64("i", F.lit(1)), F.lit(500_000)).alias("val"), F.lit(1).alias("w"), (F.col("i") % 3 == 0).alias("recent"),
                       "i").withColumn("tax", F.col("val") * (0.01 + F.col("i") / 10_000))
    got = estimate.bootstrap_variance(rows, ["g"], ["key"], "tax", "val", "w", "recent", "se2", estimates.REPS)
    se2 = np.array([r.se2 for r in got.collect()])
    assert len(se2) == 60 and se2.std() / se2.mean() < 0.2


def test_sums_equal_exploded_replicates(spark, monkeypatch):
    """Arrays that add up give what one row per record and replicate gives, over many groups, tasks and unknown values."""
    monkeypatch.setattr(resample, "GROUPS", 5)
    rng = np.random.default_rng(1)
    rows = [(f"g{i % 23}" if i % 23 else None, int(rng.integers(0, 2 ** 40)), None if i % 11 == 0 else float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, k long, v double").repartition(7)
    got = {r.g: r.total for r in resample.resampled_sums(df, ["g"], F.col("k"), {"total": F.col("v")}, 30, 4).collect()}
    drawn = resample.counts(np.array([k for _, k, _ in rows]), 30, 4)
    assert len(got) == 23
    for g in got:
        want = sum(drawn[i] * (v or 0.0) for i, (own, _, v) in enumerate(rows) if own == g)
        assert np.allclose(got[g], want)


def test_draws_follow_the_distribution_and_differ_by_stream():
    drawn = resample.counts(np.arange(4000), 100)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02
    by_row, by_replicate = np.corrcoef(drawn[:50]), np.corrcoef(drawn.T.astype(float))
    assert np.abs(by_replicate - np.eye(100)).max() < 0.1 and np.abs(by_row - np.eye(50)).max() < 0.6
    other = resample.counts(np.arange(4000), 100, 1)
    assert abs(np.corrcoef(drawn.ravel(), other.ravel())[0, 1]) < 0.01


def test_empty_table_has_no_groups(spark):
    df = spark.createDataFrame([], "g string, k long, v double")
    assert resample.resampled_sums(df, ["g"], F.col("k"), {"total": F.col("v")}, 3).count() == 0


def test_county_ratios(spark):
    groups = spark.createDataFrame([("A", "p", 0.1, 20), ("A", "q", 0.3, 5), ("B", "p", 0.9, 40), ("A", "z", None, 7)], "state string, puma string, l_hat double, n_recent long")
    states = spark.createDataFrame([("A", 0.2), ("B", 0.05), ("C", None)], "state string, state_l double")
    tracts = spark.createDataFrame([("a1", "A", "p"), ("a1", "A", "p"), ("a1", "A", "q"), ("b1", "B", "p"), ("a2", "A", "none"), ("a3", "A", "z"), ("a3", "A", "q")], "county string, state string, puma string")
    counties = spark.createDataFrame([(c, c[0].upper()) for c in ("a1", "a2", "a9", "b1", "b9", "c9")], "county string, state string")
    got = estimate.county_ratios(groups, tracts, counties, "county", "puma", "state", states).collect()
    assert sorted((r.county, r.ratio, r["sample"]) for r in got) == [
        ("a1", 1.181, 25), ("a3", 1.35, 12), ("a9", 1.221, None), ("b1", 2.0, 40), ("b9", 1.051, None)]
