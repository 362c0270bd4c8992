import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrarank.llm import exact, jaccard, mixing, queries

from ..oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"


def filled(sizes, weights=(5.0, 2.0, 1.0), fraction=1.5, most=2.0):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = fraction * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= most * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


ROWS = [(i, "word " * (i % 17), ["a", "b", "c", None, "d"][i * i % 5]) for i in range(400)] + [(900, None, "a"), (901, "", None), (902, "x " * 20_000, "b"), (7, "word " * 7, "e"), (7, "word " * 7, "e"), (None, "null id", "b")]


def test_targets_and_words(spark, documents):
    docs = documents(ROWS)
    rows = mixing.taken(docs).collect()
    again = mixing.taken(docs.repartition(5)).collect()
    assert len(rows) == len(ROWS)
    key = lambda r: (r.doc_id is None, r.doc_id, str(r.source), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    sizes: dict = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = filled(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)


def test_many_buckets_and_few_agree(spark, documents, monkeypatch):
    docs = documents(ROWS)
    many = sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.taken(docs).collect())
    monkeypatch.setattr(mixing, "BUCKETS", 1)
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.taken(docs).collect()) == many


def test_targets_are_met_where_ids_or_rows_tie(spark, documents):
    """Null ids, one repeated id, and one row repeated: within half a document of each target, in the same words every run."""
    rows = [(None, f"{i} " + "w " * 9, "a") for i in range(100)] + [(5, f"{i} " + "w " * 9, "b") for i in range(100)]
    rows += [(6, "w " * 10, "c")] * 100 + [(i + 1000, "w " * 10, "d") for i in range(100)]
    docs = documents(rows)
    out = mixing.taken(docs, (1.0, 2.0, 3.0, 5.0), 1.3, 1.9).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert all(r.n == 100 and abs(r.taken - r.target) <= 5 for r in out) and len(out) == 4
    again = mixing.taken(docs.repartition(7), (1.0, 2.0, 3.0, 5.0), 1.3, 1.9)
    key = ["source", "doc_id", "size", "copies"]
    assert not again.select(key).exceptAll(mixing.taken(docs, (1.0, 2.0, 3.0, 5.0), 1.3, 1.9).select(key)).count()
    mixed = mixing.mixed(docs, (1.0, 2.0, 3.0, 5.0), 1.3, 1.9).groupBy("source").agg((F.count("*") * 10).alias("words")).collect()
    assert sorted(map(tuple, mixed)) == sorted((r.source, r.taken) for r in out)


def test_mixed_rows_are_what_is_taken(spark, documents):
    docs = documents(ROWS)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    texts = {(d, len((t or "").split())): t for d, t, _ in ROWS}
    want = sorted((r.doc_id is None, r.doc_id or 0, texts[r.doc_id, r.size] or "") for r in mixing.taken(docs).collect() for _ in range(r.copies))
    assert got == want
    assert mixing.taken(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_unequal_weights_are_met_over_many_ids(spark):
    """Documents of the same size are taken alike often; longer ones have smaller odds."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', IF(id % 2 = 0, 5, 20))").alias("text"), F.lit("s").alias("source"))
    rows = mixing.taken(docs, (1.0,), 0.4, 1.0).groupBy("size").agg(F.avg((F.col("taken") > 0).cast("int")).alias("share")).collect()
    share = {r["size"]: r["share"] for r in rows}
    assert share[5] > share[20] > 0.25


def test_no_python_on_the_main_path(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = mixing.taken(docs)._jdf.queryExecution().toString() + mixing.mixed(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_stages(spark):
    docs = before = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.durable(stage(spark, before, FOLDER))
        if name != names[-1]:
            assert docs.columns == before.columns and 0 < docs.count()
        if name == "exact dedup":
            assert docs.count() == before.select(F.countDistinct(F.lower("text"))).first()[0]
        if name == "n-gram Jaccard join":
            assert docs.count() == jaccard.join(before).select("class_id").distinct().count()
        if name == "mixing sources":
            assert docs.count() == mixing.taken(before).agg(F.sum("copies")).first()[0]
        before = docs
    assert docs.columns == ["doc_id", "source", "ids", "n_tokens"]
    assert corpus_pipeline.run(spark, FOLDER).agg(F.sum("n_tokens")).first() == docs.agg(F.sum("n_tokens")).first()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), duck(FOLDER), queries.SQL[name]) is None


def test_every_operator_has_one_query():
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(f"op{i}" for i in range(1, 14))
    assert set(queries.SQL) < set(queries.QUERIES) and exact.TRIE_BYTES < 1 << 30
