import numpy as np
import pytest
from pyspark.sql import functions as F

from terrarank.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, x string, weight int, copies string, whitened double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "c", 0.5) for i, v in rows], SCHEMA)


def brute(vectors, components=32):
    """n, deviations, whitened values by sign-free product with the components, shares: of one list of vectors."""
    x = np.floor(64 * np.array(vectors)) + 1_000_000
    n, whole = len(x), [[int(c) for c in row] for row in x]
    sums = [sum(c) for c in zip(*whole)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in whole]
    c = x - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, deviation, c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def by_row(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    return out


@pytest.mark.parametrize("d", [3, 40])
def test_against_brute_force(spark, d):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((300, d)) * np.linspace(0.2, 2, d)).tolist()
    vectors += [vectors[0]] * 150 + [vectors[7]] * 3   # a hot vector and some copies
    unsound = [None, [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1)]
    rows = [(i, v) for i, v in enumerate(vectors + unsound)]
    got = by_row(whitening.whiten(table(spark, rows).repartition(3)))
    n, deviation, white, shares = brute(vectors)
    k = min(d, 32)
    assert sorted(got) == list(range(len(vectors)))
    sign = [np.sign(got[0][j + 1][0].whitened) * np.sign(white[0, j]) for j in range(k)]
    for i in range(len(vectors)):
        assert sorted(got[i]) == list(range(1, k + 1))
        for j in range(k):
            (r,) = got[i][j + 1]
            assert (r.n, r.deviation) == (n, deviation[i])
            assert abs(r.whitened - sign[j] * white[i, j]) < 1e-7 and abs(r.explained / shares[j] - 1) < 1e-9 and r.identity_error < 1e-9


def test_one_as_weight_fits_distinct_vectors(spark):
    vectors = np.random.default_rng(1).standard_normal((50, 2)).tolist()
    rows = list(enumerate(vectors + vectors[:30]))
    got = by_row(whitening.whiten(table(spark, rows), whitening.Settings(weighted=False)))
    n, deviation, white, _ = brute(vectors)
    assert got[0][1][0].n == n == 50 and got[60][1][0].deviation == deviation[10]
    assert np.allclose(np.abs([got[i][1][0].whitened for i in range(50)]), np.abs(white[:, 0]))


def test_copies_ties_lengths_and_degenerate_dimensions(spark):
    line = [[float(i), 2.0 * i, 5.0] for i in range(10)]                 # one component besides noise
    rows = [(i, v) for i, v in enumerate(line)]
    rows += [(3, line[3]), (None, line[4]), (None, line[4])]             # repeated and missing ids
    rows += [(100 + i, [float(i), float(i * i)]) for i in range(6)]      # another length
    rows += [(200, []), (201, [1.0]), (202, [1.0, 2.0, 3.0, 4.0])]       # nothing to scale
    got = by_row(whitening.whiten(table(spark, rows)))
    assert set(got) == {*range(10), None, *range(100, 106)}
    assert len(got[3][1]) == 2 and len(got[None][1]) == 2 and set(got[3]) == {1} and got[3][1][0].n == 13
    assert set(got[100]) == {1, 2} and got[100][1][0].n == 6
    assert abs(got[3][1][0].explained - 1) < 1e-12


def test_huge_entries_and_sums(spark):
    rows = [(i, [v, 1.0 + i]) for i, v in enumerate([1e300, -1e300, 0.0, 1e15])]
    got = by_row(whitening.whiten(table(spark, rows)))
    assert set(got) == {0, 1, 2, 3} and got[0][1][0].deviation is None and set(got[2]) == {1}   # the other dimension is noise beside it
    q, r = whitening._divided(3, (10, -10))
    assert q.tolist() == [3, -4] and r.tolist() == [1, 2]


def test_empty_table(spark):
    df = whitening.whiten(table(spark, []))
    assert df.count() == 0 and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0


def test_hot_vectors_are_joined_once(spark):
    vectors = [[float(i % 7), float(i % 11), float(i % 13)] for i in range(2002)] + [[1.0, 2.0, 3.0]] * 1000
    out = whitening.whiten(table(spark, list(enumerate(vectors))))
    assert out.count() == 3002 * 3
    assert out.groupBy("vec_id").count().where("count <> 3").count() == 0
    assert out.where("vec_id >= 2002").select("whitened", "component").distinct().count() == 3
    assert abs(out.agg(F.avg("whitened")).first()[0]) < 1e-9
