"""A corpus made ready for training: quality, exact copies, near copies, the mix of sources, token ids.

Each stage takes (spark, docs, folder of the tables) and gives a table; it is written as Parquet and read again as the next
stage's documents. All but the last give the columns of ``documents``. Empty tables pass through every stage; rows with null
text or null doc_id are judged like others (a null text is an empty text).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as public
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrarank.llm import bpe, exact, jaccard, mixing, quality
from terrarank.session import durable


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from all labelled rows among them."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.learn(docs, labels, F.lit(True))
    return quality.accepted(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each text: that with the largest doc_id."""
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group that near copies connect: that with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken, not at all to twice."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, source, token ids and their number of every row."""
    return bpe.encode(docs, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN, ("doc_id", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup),
    ("mixing sources", mixed), ("byte-level BPE", encoded),
]

# The classifier and the tokens can't be had from SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
