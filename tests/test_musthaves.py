"""Must-haves of many searches: the index shows what a test of all pairs shows, and meets few places besides."""

import random

import pytest
from pyspark.sql import functions as F

from terrarank.operators import musthaves, score
from terrarank.session import durable

LIMITS, ACCEPTS = "search string, metric string, min double, max double", "search string, category string, accept array<string>"
PLACES = "k long, a double, b long, c string, d string"


def drawn(seed):
    draw = random.Random(seed)
    some = lambda v, share: None if draw.random() < share else v
    places = [(k, some(draw.choice([0.0, 1.0, draw.uniform(-5, 5)]), 0.2), some(draw.randrange(9), 0.1), some(draw.choice("xyz"), 0.2), some(draw.choice("xyz"), 0.5))
              for k in range(120)]
    places += [(900, float("nan"), 3, "x", None), (901, float("inf"), 3, "x", "x"), (902, float("-inf"), None, "q", "x")]
    limits, accepts = [], []
    for s in range(25):
        low, high = draw.uniform(-6, 6), draw.uniform(-6, 6)
        limits += [(f"s{s}", m, some(low, 0.3), some(high, 0.3)) for m in draw.sample(["a", "b", "no such measure", "a"], draw.randrange(4))]
        accepts += [(f"s{s}", "c", draw.sample(["x", "y", "z", "w", None], draw.randrange(4)))] * draw.randrange(2)
    return places, limits, accepts


@pytest.mark.parametrize("seed", [1, 2])
def test_the_index_shows_what_all_pairs_show(spark, monkeypatch, seed):
    monkeypatch.setattr(musthaves, "PIECE_ROWS", 7)
    places, limits, accepts = drawn(seed)
    df, lim, acc = spark.createDataFrame(places, PLACES), spark.createDataFrame(limits, LIMITS), spark.createDataFrame(accepts, ACCEPTS)
    named = lim.select("search").union(acc.select("search")).distinct()
    got = musthaves.shown_places(df, "k", named.union(spark.createDataFrame([("free",)], "search string")), lim, acc, {"c": "d"})
    want = score.filter_results(df, "k", lim, acc, {"c": "d"}).where("status < 2")
    rows = lambda f: sorted((r["search"], r["k"], r["status"], tuple(r["unknown"])) for r in f.collect())
    assert rows(got) == sorted(rows(want) + [("free", p[0], 0, ()) for p in places])
    counts = {r["search"]: (r["match"], r["unknown"], r["excluded"]) for r in musthaves.shown_counts(got, named, df).collect()}
    dense = {r["search"]: (r["match"], r["unknown"], r["excluded"]) for r in score.status_counts(score.filter_results(df, "k", lim, acc, {"c": "d"})).collect()}
    assert counts == dense


def test_nothing_to_search_in_and_nothing_asked(spark):
    df, lim = spark.createDataFrame([], PLACES), spark.createDataFrame([("s", "a", 0.0, 1.0)], LIMITS)
    assert musthaves.shown_places(df, "k", lim, lim).count() == 0
    df = spark.createDataFrame([(1, None, None, None, None)], PLACES)
    assert [tuple(r) for r in musthaves.shown_places(df, "k", lim, lim).collect()] == [("s", 1, 1, ["a"])]
    assert musthaves.shown_places(df, "k", lim.limit(0), lim.limit(0)).count() == 0


def test_places_met_follow_those_that_pass(spark):
    """As many searches as places, each letting through about 40 of them: places met per search grow at most as the root of the places."""
    met = {}
    for n in (1000, 4000, 16000):
        df = spark.range(n).select(F.col("id").alias("k"), (F.pow(F.rand(3), 3) * n).alias("a"), (F.col("id") % 2).alias("b"))
        df = durable(df)
        asked = df.where("k % 10 = 0").select(F.col("k").alias("search"), F.explode(F.array(
            F.struct(F.lit("a").alias("metric"), (F.col("a") - 5).alias("min"), (F.col("a") + 5).alias("max")),
            F.struct(F.lit("b").alias("metric"), F.lit(0.0).alias("min"), F.lit(None).cast("double").alias("max")))).alias("m")).select("search", "m.*")
        pairs, shown = musthaves._met(df, "k", asked, asked, None, {}).count(), musthaves.shown_places(df, "k", asked, asked).count()
        met[n] = (pairs - shown) / (n / 10)
        assert pairs >= shown
    assert met[16000] <= 4.5 * max(met[1000], 5.0) and met[16000] < 16000 / 64


def test_scores_of_shown_places_are_those_of_all(spark):
    from terrarank.operators import rank

    places, limits, accepts = drawn(3)
    df, lim = spark.createDataFrame(places[:120], PLACES), spark.createDataFrame(limits, LIMITS)
    asked = lim.select("search").distinct().select("search", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(w).alias("weight"), F.lit(d).alias("direction"))
                                                                                for m, w, d in (("a", 9.0, "lower"), ("b", 2.0, "middle"), ("b2", 0.0, "higher"))])).alias("x")).select("search", "x.*")
    dense = score.scores(df, "k", asked, score.contributions(df, "k", asked, ["a", "b"]), score.filter_results(df, "k", lim)).where("status < 2")
    ranked = rank.rank_rows(rank.unpivot(df, ["k"], ["a", "b"]), ["k"], ["metric"])
    got = musthaves.shown_scores(musthaves.shown_places(df, "k", lim, lim), "k", ranked, asked)
    rows = lambda f: {(r["search"], r["k"]): (r["status"], pytest.approx(r["score"])) for r in f.collect()}
    assert rows(got) == rows(dense) and rows(dense)


def test_watch_outs_of_listed_results(spark):
    ranked = spark.createDataFrame([(1, "a", 97.0), (1, "b", 99.0), (2, "a", 96.0), (2, "b", 10.0)], "k int, metric string, lo double")
    asked = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 0.0), ("t", "c", 1.0)], "search string, metric string, weight double")
    listed = spark.createDataFrame([("s", 1), ("t", 2)], "search string, k int")
    rows = lambda f: sorted((r["search"], r["k"], r["metric"], r["worse_than"]) for r in f.collect())
    assert rows(score.watch_outs(ranked, "k", ["a", "b"], asked, listed=listed)) == [("s", 1, "b", 99), ("t", 2, "a", 96)]
    assert rows(score.watch_outs(ranked, "k", ["a", "b"], asked)) == [("s", 1, "b", 99), ("t", 1, "a", 97), ("t", 1, "b", 99), ("t", 2, "a", 96)]


def given(spark, seed):
    places, limits, accepts = drawn(seed)
    places += [places[3], (7, 1.0, 4, "y", "z"), (None, 0.0, 2, "x", None)]     # keys may repeat or be null
    accepts += [("s1", "c", ["x", "z"]), ("s2", "no such column", ["x"]), ("s3", "d", ["y"])]
    df, lim, acc = spark.createDataFrame(places, PLACES), spark.createDataFrame(limits, LIMITS), spark.createDataFrame(accepts, ACCEPTS)
    named = lim.select("search").union(acc.select("search")).union(spark.createDataFrame([("free",), (None,)], "search string")).distinct()
    return musthaves.Asked(df, "k", named, lim, acc, {"c": "d"})


@pytest.mark.parametrize("seed,most", [(4, 3), (5, 0)])
def test_counts_without_pairs_are_those_of_pairs(spark, monkeypatch, seed, most):
    monkeypatch.setattr(musthaves, "MEASURES_NESTED", most)
    asked = given(spark, seed)
    rows = lambda f: {r["search"]: (r["match"], r["unknown"], r["excluded"]) for r in f.collect()}
    assert rows(musthaves.shown_counts(asked, asked.searches, asked.places)) == rows(musthaves.shown_counts(asked.of(asked.searches), asked.searches, asked.places))


def test_the_best_without_pairs_are_those_of_pairs(spark):
    asked = given(spark, 6)
    weights = [("a", 3.0, "higher"), ("b", 2.0, "lower")], [("b", 1.0, "middle")]
    named = [r[0] for r in asked.searches.where("search <> 's5'").collect()]
    criteria = spark.createDataFrame([(s, *w) for i, s in enumerate(sorted(named)) for w in weights[i % 2]], "search string, metric string, weight double, direction string")
    ranked = spark.createDataFrame([(k, m, float(k * p % 10 * 10), float(k * p % 10 * 10), 50.0) for k in range(100) for m, p in (("a", 7), ("b", 3))],
                                   "k long, metric string, lo double, hi double, mid double")

    def best(found):
        top = score.ranked(musthaves.shown_scores(found, "k", ranked, criteria), "k", 3)
        return sorted((r["search"], r["position"], r["k"] is None, r["k"], r["status"], r["score"], r["unknown"]) for r in top.collect())

    few = musthaves.best_places(asked, ranked, criteria, 3)
    assert best(few) == best(asked.of(asked.searches))
    assert few.groupBy("search").count().where("count > 3").isEmpty() and few.count() > 30


def test_counting_does_not_follow_the_places_shown(spark):
    """Each search shows about half of all places; four times the places let what is read per search grow by two levels a measure."""
    read = {}
    for n in (500, 2000):
        df = durable(spark.range(n).select(F.col("id").alias("k"), F.rand(3).alias("a"), F.rand(4).alias("b")))
        asked = df.select(F.col("k").alias("search"), F.explode(F.array(
            F.struct(F.lit("a").alias("metric"), (F.col("a") - 0.4).alias("min"), (F.col("a") + 0.4).alias("max")),
            F.struct(F.lit("b").alias("metric"), F.lit(None).cast("double").alias("min"), (F.col("b") + 0.2).alias("max")))).alias("m")).select("search", "m.*")
        nests, apart, _ = musthaves._nests(musthaves.Asked(df, "k", df.select(F.col("k").alias("search")), asked))
        assert apart.isEmpty() and len(nests) == 1
        read[n] = nests[0].lookups().count() / n, nests[0].entries(nests[0].places).count() / n
    assert all(more <= 2.0 * fewer for more, fewer in zip(read[2000], read[500]))
