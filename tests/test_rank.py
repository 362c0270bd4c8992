"""Ranks: ties, lone and unknown values, and the sliced and salted paths that only large groups take."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrarank.operators import rank
from terrarank.session import Limits

TINY = Limits(hot_rows=10, salts=4, slices=9)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def bounds_of(spark, values, limits=Limits()):
    df = frame(spark, [(i, "m", float(v) if v is not None else None) for i, v in enumerate(values)], "k int, metric string, value double")
    known = df.filter("value IS NOT NULL")
    return {r["k"]: (r["lo"], r["hi"], r["mid"]) for r in rank.rank_rows(known, ["k"], ["metric"], limits=limits).collect()}


def expected(values):
    known = sorted(v for v in values if v is not None)
    n = len(known)
    out = {}
    for i, v in enumerate(values):
        if v is None:
            continue
        if n == 1:
            out[i] = (50.0, 50.0, 50.0)
            continue
        below, upto = sum(x < v for x in known), sum(x <= v for x in known)
        lo, hi = 100 * below / (n - 1), 100 * (upto - 1) / (n - 1)
        out[i] = (lo, hi, (lo + hi) / 2)
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_ties_share_bounds_and_best_scores_100(spark):
    got = bounds_of(spark, [1, 2, 2, 5, None])
    same(got, expected([1, 2, 2, 5, None]))
    assert bounds_of(spark, [0, 0, 0, 9])[0][0] == 0.0  # 100 - lo = 100 for everyone at the best value


def test_lone_value_and_no_values(spark):
    assert bounds_of(spark, [3, None]) == {0: (50.0, 50.0, 50.0)}
    assert bounds_of(spark, [None, None]) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_sliced_and_salted_paths_agree(spark, seed):
    rng = random.Random(seed)
    # A third of all rows share one value; the rest are spread over many slices.
    values = [5.0 if rng.random() < 0.34 else round(rng.uniform(-50, 50), 1) for _ in range(300)]
    same(bounds_of(spark, values, TINY), expected(values))


def test_sliced_groups(spark):
    rng = random.Random(7)
    rows = [(i, "big" if i % 3 else f"g{i % 9}", float(rng.randint(0, 60))) for i in range(400)]
    df = frame(spark, rows, "k int, g string, v double")
    a = {r["k"]: (r["rank"], r["group_count"]) for r in rank.group_rank(df, ["k"], ["g"], "v", limits=TINY).collect()}
    for k, g, v in rows:
        mine = [x for _, h, x in rows if h == g]
        assert a[k] == (1 + sum(x > v for x in mine), len(mine))


def test_row_positions_inside_ties(spark):
    rows = [(i, "a" if i < 250 else "b", float(i % 5)) for i in range(300)]
    df = frame(spark, rows, "k int, g string, v double")
    got = {r["k"]: r["position"] for r in rank.row_positions(df, ["g"], "v", "k", descending=True, limits=TINY).collect()}
    for g in "ab":
        order = sorted([(k, v) for k, h, v in rows if h == g], key=lambda x: (-x[1], x[0]))
        assert [got[k] for k, _ in order] == list(range(1, len(order) + 1))


def test_quantiles_and_weighted_median(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=157).round(2)
    w = rng.integers(1, 9, size=157)
    df = frame(spark, [("x", float(a), int(b)) for a, b in zip(v, w)], "g string, v double, w int")
    for limits in (Limits(), TINY):
        q = rank.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9], ["a", "b", "c"], limits).first()
        assert [q["a"], q["b"], q["c"]] == pytest.approx(list(np.quantile(v, [0.1, 0.5, 0.9])), abs=1e-12)
        order = np.argsort(v, kind="stable")
        cum = np.cumsum(w[order])
        want = v[order][np.searchsorted(cum, cum[-1] / 2)]
        assert rank.weighted_median(df, ["g"], "v", "w", limits=limits).first()["weighted_median"] == want
        assert rank.upper_median(df, ["g"], "v", limits=limits).first()["median"] == sorted(v)[157 // 2]


def test_standing_in_a_curve(spark):
    curve = frame(spark, [(float(x),) for x in (1, 2, 2, 4, 8)], "c double")
    points = frame(spark, [(0, 2.0), (1, 0.5), (2, 100.0), (3, None), (4, 3.0)], "k int, p double")
    for limits in (Limits(), Limits(slices=5)):
        got = {r["k"]: r["s"] for r in rank.share_at_or_below(points, "p", curve, "c", "s", limits=limits).collect()}
        assert got == {0: 60.0, 1: 0.0, 2: 100.0, 3: None, 4: 60.0}


def test_three_percentiles_differ(spark):
    df = frame(spark, [(i, float(v)) for i, v in enumerate([1, 1, 2])], "k int, v double")
    got = {r["k"]: r["p"] for r in rank.average_rank_percentile(df, ["k"], [], "v", "p").collect()}
    assert got[0] == pytest.approx(50.0) and got[2] == pytest.approx(100.0)


def test_narrow_spread_is_not_stretched(spark):
    df = frame(spark, [(i, s) for i, s in enumerate([80.0, 78.0, 72.0, 10.0])], "k int, score double")
    got = {r["k"]: r["relative"] for r in rank.stretch(df, "score", [F.desc("score")], 3).collect()}
    assert got == {0: 100.0, 1: 90.0, 2: 60.0}


def test_explain_has_no_global_sort_window(spark):
    """With splitting forced, no window is left without partition keys."""
    df = frame(spark, [(i, "m", float(i)) for i in range(100)], "k int, metric string, value double")
    plan = rank.value_bounds(df, ["metric"], limits=TINY)._jdf.queryExecution().optimizedPlan().toString()
    assert "_p" in plan
