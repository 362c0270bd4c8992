import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrarank.llm import embeddings, exact, jaccard, lattice
from terrarank.llm.components import components
from terrarank.session import durable


def tokens(text):
    w = [x.encode().lower() for x in (text or "").split()]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def closure(ids, links):
    low = {i: i for i in ids}
    while True:
        new = {i: min([low[i], *(low[j] for j in links[i])]) for i in ids}
        if new == low:
            return low
        low = new


def brute_join(rows):
    sets = [tokens(t) for _, t, _ in rows]
    links = {i: {j for j in range(len(rows)) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8} for i in range(len(rows))}
    return links


def texts(n, seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    while len(out) < n:
        base = [random.choice(words) for _ in range(random.randint(3, 120))]
        for _ in range(random.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = random.choice(words)
            out.append(" ".join(copy))
    return out[:n]


@pytest.mark.parametrize("limit,block", [(256, 512), (2, 3)])
def test_join_against_brute_force(spark, documents, monkeypatch, limit, block):
    monkeypatch.setattr(jaccard.linked, "__defaults__", (block,))
    rows = [(i * 3, t, "a") for i, t in enumerate(texts(150, 1))]
    rows += [(1000 + i, "hot passage of shared words here " * 30 + f" end {i % 4}", "hot") for i in range(40)]
    rows += [(2000, None, None), (2001, "", "a"), (2002, "One two", "a"), (2003, "one  TWO", "a"), (2004, "word " * 20_000, "a"), (2005, "word " * 20_001, "a")]
    got = {r.doc_id: r for r in jaccard.join(documents(rows), jaccard.Settings(limit=limit)).collect()}
    links = brute_join(rows)
    low = closure(range(len(rows)), links)
    assert len(got) == len(rows)
    for i, (d, _, _) in enumerate(rows):
        assert got[d].n_links == len(links[i]), d
        assert got[d].class_id == min(rows[j][0] for j in range(len(rows)) if low[j] == low[i]), d


def test_join_edges(spark, documents):
    docs = documents([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "p q r s t u", None), (5, "p q r s t u", "x"), (6, "p q r s t", "y")])
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.class_id, r.n_links, r.n_copies) for r in jaccard.join(docs).collect())
    assert rows == [(False, 1, 1, 1, 2), (False, 1, 1, 1, 2), (False, 5, None, 1, 2), (False, 6, 6, 0, 1), (True, 0, None, 1, 2)]
    stays = jaccard.one_of_each(docs)
    assert stays.columns == docs.columns and sorted(str(r.doc_id) for r in stays.collect()) == ["1", "1", "6", "None"]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_rows_of_one_id_or_none_are_judged_by_their_texts(spark, documents):
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:-1], f"x{k}"])
    alone = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    docs = documents([(3, near(0), "x"), (7, near(1), "x"), (7, alone[0], "clean"), (None, alone[1], "clean"), (None, alone[2] + " y", "n"), (None, alone[2] + " z", "n")])
    stays = sorted(r.source for r in jaccard.one_of_each(docs).collect())
    assert stays == ["clean", "clean", "n", "x"]
    got = {(r.doc_id, r.class_id) for r in jaccard.join(docs).collect()}
    assert got == {(3, 3), (7, 3), (None, None)}   # rows of one id are one document there


def test_number_of_runs_by_simulation():
    s = jaccard.Settings()
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**16, (400, s.positions), dtype=np.uint16)
    b = np.where(rng.random(a.shape) < s.threshold, a, a + 1)
    for depth in (2, 5):
        met, runs = [], 12
        for r in range(runs):
            seen = []
            for values in (a, b):
                row, path = np.arange(len(a)), np.full(len(a), jaccard.mix(np.array([r], np.uint64))[0])
                for _ in range(depth):
                    row, path = jaccard.children(row, path, values, s.threshold)
                seen.append({(int(i), int(p)) for i, p in zip(row, path)})
            met.append(len({i for i, _ in seen[0] & seen[1]}) / len(a))
        assert abs(np.mean(met) - s.shared(s.threshold, depth)) < 0.06
        assert jaccard.Settings(recall=0.99).runs(depth) < s.runs(depth)
    assert s.runs(2) == 12


@pytest.mark.parametrize("settings", [jaccard.Settings(), jaccard.Settings(limit=8)])
def test_recall_of_nodes(spark, settings):
    """Texts at the threshold share a node, whether nodes are split once or many times; copies stay together."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**16, (300, settings.positions), dtype=np.uint16)
    hot = base[0]
    far = np.where(rng.random((300, settings.positions)) < 0.55, hot, rng.integers(0, 2**16, base.shape, dtype=np.uint16))   # a shared template
    left = np.concatenate([base, far])
    right = np.where(rng.random(left.shape) < settings.threshold, left, rng.integers(0, 2**16, left.shape, dtype=np.uint16))
    n = len(left)
    rows = [(i, bytes(v.tobytes())) for i, v in enumerate(np.concatenate([left, right]))]
    sets_ = jaccard.durable(spark.createDataFrame(rows, "id long, sketch binary"))
    found = jaccard.nodes(sets_, settings)
    a, b = found.alias("a"), found.alias("b")
    met = a.join(b, F.expr("a.bucket = b.bucket AND b.id = a.id + %d" % n)).where(F.col("a.id") < n).select("a.id").distinct().count()
    assert met >= n - 1
    if settings.limit == 8:
        assert found.groupBy("bucket").count().agg(F.max("count")).first()[0] < 60   # 300 to 600 texts of the template met at first


def test_nodes_of_a_template_stay_small(spark, documents):
    """Texts that share a long template are split apart: pairs to compare grow with the texts, not with their square."""
    random.seed(4)
    template = [f"t{i}" for i in range(100)]
    compared = []
    for n in (500, 2000):
        docs = documents([(i, " ".join(template + [f"d{i}x{j}" for j in range(80)]), "t") for i in range(n)])
        s = jaccard.Settings(limit=32)
        drawn = jaccard.durable(jaccard.sketches(docs, s))
        found = jaccard.nodes(jaccard.durable(drawn.select(F.col("doc_id").alias("id"), "sketch")), s)
        sizes = found.groupBy("bucket").count()
        compared.append(sizes.agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0] / n)
    assert compared[1] < 1.6 * compared[0], compared


def test_sets_are_matched_with_shared_nodes_once_a_level(spark, documents):
    rows = [(i, " ".join(["same"] * 30 + [f"w{i}"]), "a") for i in range(40)]
    drawn = durable(jaccard.sketches(documents(rows), jaccard.Settings()).withColumnRenamed("doc_id", "id"))
    done, went, _ = jaccard._settled(durable(jaccard.started(drawn, 0, 12, jaccard.Settings())), drawn, jaccard.Settings(limit=8, similar=1.1), 5)
    assert went and len(done) > 1
    assert not [t for t in done if "Join" in t._jdf.queryExecution().optimizedPlan().toString()]


def test_alike_sets_are_not_split(spark, documents):
    base = [f"w{i}" for i in range(200)]
    docs = documents([(i, " ".join([*base[:-1], f"x{i}"]), "t") for i in range(300)])
    drawn = jaccard.durable(jaccard.sketches(docs, jaccard.Settings(limit=16)))
    sets_ = jaccard.durable(drawn.select(F.col("doc_id").alias("id"), "sketch"))
    s = jaccard.Settings(limit=16)
    assert jaccard._settled(jaccard.durable(jaccard.started(sets_, 0, 2, s)), sets_, s, s.depth)[1] == []
    got = jaccard.join(docs, s).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 299)}


def test_columns_of_any_name_pass(spark):
    rows = [(1, "a b c d e f g", 5, 6, "p", "q"), (2, "a b c d e f g", 7, 8, "r", "s"), (3, "z", 9, 10, "t", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __k1 long, __G2 long, __sha string, `__keep` string")
    assert sorted(jaccard.one_of_each(docs).collect()) == [rows[0], rows[2]]
    stays = exact.without_copies(docs)
    assert stays.columns == docs.columns and sorted(stays.collect()) == [rows[1], rows[2]]


def test_components_against_closure(spark):
    random.seed(9)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    both = {}
    for a, b in links:
        if a != b:
            both.setdefault(a, set()).add(b)
            both.setdefault(b, set()).add(a)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == closure(list(both), both)


def test_lattice_points_are_nearest():
    y = np.random.default_rng(0).normal(size=(500, 8)) * 2
    p = lattice.nearest(y)
    assert len(lattice.ROOTS) == 240 and ((lattice.ROOTS ** 2).sum(1) == 2).all()
    around = ((y[:, None] - p[:, None] - lattice.ROOTS[None]) ** 2).sum(2).min(1)
    own = ((y - p) ** 2).sum(1)
    assert (own <= around + 1e-9).all() and own.max() <= 1 + 1e-9
    assert ((2 * p) % 1 == 0).all() and (p.sum(1) % 2 == 0).all()
    c = lattice.cells(y, 4)
    assert c.shape == (500, 5, 8) and (((c[:, 1:] - c[:, :1]) ** 2).sum(2) == 2).all()


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(1)
    x = embeddings.unit(rng.normal(size=(4000, 64)))
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    z = 0.95 * x + (1 - 0.95 ** 2) ** 0.5 * embeddings.unit(away)
    s = embeddings.Settings()
    met = (embeddings.buckets(x, s)[:, :, None] == embeddings.buckets(z, s)[:, None, :]).any((1, 2))
    assert met.mean() > 0.999


def test_stated_probability_of_a_table_is_measured():
    rng, s = np.random.default_rng(1), embeddings.Settings()
    x = embeddings.unit(rng.normal(size=(4000, 64)))
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    p, q = (embeddings.buckets(v, s) for v in (x, 0.95 * x + (1 - 0.95 ** 2) ** 0.5 * embeddings.unit(away)))
    n = 1 + s.probes
    met = [(p[:, t * n:t * n + n, None] == q[:, None, t * n:t * n + n]).any((1, 2)).mean() for t in range(s.tables)]
    stated = float(embeddings.__doc__.split("one table with probability ")[1][:4])
    assert abs(np.mean(met) - stated) < 0.02


@pytest.mark.parametrize("block", [512, 8])
def test_embeddings_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings.linked, "__defaults__", (block,))
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    v = [(c + 0.08 * rng.normal(size=16)).astype(np.float32).tolist() for c in centres for _ in range(5)]
    v += [v[0]] * 30 + [(3 * np.array(v[1])).tolist()]
    rows = [(i * 2, x, 0, "z") for i, x in enumerate(v)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [float("inf")] + [1.0] * 15), (9006, [1.0, 2.0]), (9007, [])]
    rows += [(i, x, None, "z") for i, x in odd]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    assert len(got) == len(rows)
    u = embeddings.unit(np.array(v, np.float32))
    near = (u @ u.T >= 0.95) & ~np.eye(len(v), dtype=bool)
    links = {i: set(np.flatnonzero(near[i]).tolist()) for i in range(len(v))}
    low = closure(range(len(v)), links)
    for i in range(len(v)):
        r = got[2 * i]
        assert (r.n_links, r.component_id, r.kept) == (len(links[i]), 2 * low[i], low[i] == i)
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_repeated_and_null_vector_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [1.0, 0.001])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {None}
    assert all(r.n_links >= 1 for r in got)
