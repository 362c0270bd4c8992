import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrarank.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.1"


def auc(label, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    _, at = np.unique(score, return_inverse=True)
    rank = (np.bincount(at, rank) / np.bincount(at))[at]
    yes = label == 1
    return (rank[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())


@pytest.mark.parametrize("module,label,parts,part,least", [(quality, "quality", 5, 0, 0.98), (toxicity, "toxic", 4, 2, 0.88)])
def test_held_out_accuracy(spark, module, label, parts, part, least):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    held = quality.held_out(F.col("doc_id"), parts, part)
    model = module.learn(docs, labels, ~held)
    rows = module.score(docs, model).join(labels.where(held), "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % parts == part for i in rows.doc_id)
    assert auc(rows[label].to_numpy(), rows.score.to_numpy()) > least
    assert ((rows.predicted == 1) == (rows.score >= 0.3)).all()
    assert (rows.predicted == rows[label]).mean() > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, documents, module):
    docs = documents([(1, None, "a"), (2, "", "a"), (None, "some words", None), (3, "word " * 30_000, "b"), (4, "same text", "b"), (4, "same text", "b")])
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 1), (None, 1, 1), (3, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = module.learn(docs, labels, F.lit(True))
    rows = module.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows if r.doc_id in (1, 2)}
    assert by[1] == by[2]
    assert module.score(docs.limit(0), model).count() == 0
    none = module.learn(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in module.score(docs, none).collect()} == {0.5 if module is quality else 0.0}


def test_votes_agree_with_all_cosines():
    rng = np.random.default_rng(0)
    model = quality.Model(np.eye(8, dtype=np.float32), np.zeros((0, 8)), rng.integers(0, 2, 300).astype(float), quality.Settings(voters=5, power=3.0))
    model.vectors = model.latent(rng.standard_normal((300, 8)).astype(np.float32))
    query = rng.standard_normal((40, 8)).astype(np.float32)
    got = model.score(query)
    for q, s in zip(model.latent(query), got):
        cosine = model.vectors @ q
        near = np.argsort(-cosine)[:5]
        weight = np.maximum(cosine[near], 0).astype(float) ** 3
        assert abs(s - (weight * model.labels[near]).sum() / weight.sum()) < 1e-5


def test_accepted_keeps_columns(spark, documents):
    docs = documents([(i, f"plain words number {i} here", "a") for i in range(20)] + [(100 + i, "X!!! Y!!! X!!! Y!!! " * 5, "a") for i in range(20)])
    labels = docs.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("quality"))
    stays = quality.accepted(docs, quality.learn(docs, labels, F.lit(True)))
    assert stays.columns == docs.columns and {r.doc_id for r in stays.collect()} == set(range(20))


def test_risk_is_not_negative_where_unlabelled_holds_positives():
    rng = np.random.default_rng(1)
    bad, common = np.uint64(7), np.arange(100, 140, dtype=np.uint64)
    draw = lambda toxic: np.sort(np.append(rng.choice(common, 10, replace=False), [bad] if toxic else []).astype(np.uint64))
    positive, unlabelled = [draw(True) for _ in range(60)], [draw(k % 10 == 0) for k in range(400)]
    model = toxicity.train(positive, unlabelled, 0.1, toxicity.Settings())
    both = [draw(True), draw(False)]
    s = model.score(2, np.repeat([0, 1], [len(x) for x in both]), np.concatenate(both))
    assert s[0] > 0.3 > s[1]
