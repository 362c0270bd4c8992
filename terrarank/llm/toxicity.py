"""Operator 2, toxicity: non-negative positive-unlabelled learning.

Positives are rows confirmed toxic; unlabelled text is a sample of all documents of the learning folds, whatever their
labels. A linear model on the words a text holds is trained in numpy on the class-prior-corrected risk
``prior * P[loss(+)] + max(0, U[loss(-)] - prior * P[loss(-)])``; where the second part falls below zero its gradient is
turned round, so unlabelled toxic text is not learnt as clean. The class prior is the share of toxic rows among the labelled
ones of the learning folds (``labels`` is a random sample of documents).

Edges: null text is empty text and scores by the bias alone; without a confirmed example every score is 0; labels that
disagree on one doc_id count as toxic; rows with a null label or doc_id teach nothing; repeated rows get a row each; words
that the sample did not hold add nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import MARKS, Words, as_bytes, forget, slices


@dataclass(frozen=True)
class Settings:
    positives: int = 4096     # most confirmed examples that are learnt from
    unlabelled: int = 8192    # most unlabelled texts that are learnt from
    words_per_text: int = 4096   # most different words of one sampled text, the smallest hashes; scoring takes all
    seen_in: int = 4          # a word must be in so many sampled texts
    vocabulary: int = 1024    # most words kept, those that tell most first
    beyond_chance: float = 1.5   # of the log of the number of words, in G2
    steps: int = 600
    rate: float = 0.05
    decay: float = 3e-5
    threshold: float = 0.3


@dataclass
class Model:
    words: np.ndarray   # sorted hashes
    weights: np.ndarray
    bias: float
    settings: Settings

    def score(self, rows: int, doc: np.ndarray, word: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(rows, 1 / (1 + np.exp(-self.bias)))
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        known = self.words[at] == word
        margin = np.bincount(doc[known], self.weights[at[known]], minlength=rows) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def distinct_words(column: pa.Array) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, and the rows and hashes of each text's different words."""
    w = Words(*as_bytes(column), MARKS)
    order = np.lexsort((w.hash, w.doc))
    doc, word = w.doc[order], w.hash[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
    return w.rows, doc[new], word[new]


def association(a: np.ndarray, b: np.ndarray, p: int, u: int) -> np.ndarray:
    """Log-likelihood ratio (G2) of words in ``a`` of ``p`` texts against ``b`` of ``u``."""
    total, part = p + u, lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0)
    seen = a + b
    return 2 * (part(a, seen * p / total) + part(b, seen * u / total) + part(p - a, (total - seen) * p / total) + part(u - b, (total - seen) * u / total))


def _different(texts: list[np.ndarray]) -> list[np.ndarray]:
    """One of the texts whose four smallest word hashes are the same: copies and most near copies would make any of their words tell."""
    return list({tuple(np.sort(t)[:4].tolist()): t for t in reversed(texts)}.values())


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, settings: Settings) -> Model:
    """Adam on the non-negative risk with the logistic loss."""
    none = np.zeros(0, np.uint64)
    positive, unlabelled = _different(positive), _different(unlabelled)
    if not positive or not unlabelled:
        return Model(none, np.zeros(0), -np.inf, settings)
    texts = [*positive, *unlabelled]
    found, times = np.unique(np.concatenate([none, *texts]), return_counts=True)
    mine = np.zeros(len(found))
    held, of = np.unique(np.concatenate([none, *positive]), return_counts=True)
    mine[np.searchsorted(found, held)] = of
    tells = association(mine, times - mine, len(positive), len(unlabelled))
    # words that are further apart than chance brings the furthest of so many words
    often = times >= settings.seen_in
    keep = np.flatnonzero(often & (tells > settings.beyond_chance * np.log(max(2, often.sum()))))
    keep = np.sort(keep[np.argsort(-tells[keep], kind="stable")[: settings.vocabulary]])
    words, size = found[keep], np.array([len(t) for t in texts])
    doc, word = np.repeat(np.arange(len(texts)), size), np.concatenate([none, *texts])
    at = np.minimum(np.searchsorted(words, word), max(0, len(words) - 1))
    known = words[at] == word if len(words) else np.zeros(len(word), bool)
    doc, at = doc[known], at[known]
    p, n = len(positive), len(texts)
    prior = float(np.clip(prior, 1e-3, 0.9))
    x, moment, second = np.zeros(len(words) + 1), np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    x[-1] = np.log(prior / (1 - prior))
    for step in range(1, settings.steps + 1):
        margin = np.bincount(doc, x[at], minlength=n) + x[-1]
        yes = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        # slopes of loss(+) = log(1 + e^-m) and loss(-) = log(1 + e^m) in the margin
        lost = np.logaddexp(0, margin)
        negative = lost[p:].mean() - prior * lost[:p].mean()
        slope = np.empty(n)
        if negative >= 0:
            slope[:p] = prior / p * ((yes[:p] - 1) - yes[:p])
            slope[p:] = yes[p:] / (n - p)
        else:
            slope[:p] = prior / p * yes[:p]
            slope[p:] = -yes[p:] / (n - p)
        g = np.append(np.bincount(at, slope[doc], minlength=len(words)), slope.sum()) + settings.decay * x
        moment, second = 0.9 * moment + 0.1 * g, 0.999 * second + 0.001 * g * g
        x -= settings.rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Model(words, x[:-1], float(x[-1]), settings)


def _texts(docs: DataFrame, most: int, words: int) -> list[np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch):
                rows, doc, word = distinct_words(piece.column("text"))
                first = np.searchsorted(doc, np.arange(rows + 1))
                lists = [np.sort(word[a:b])[:words].astype(np.int64) for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "words"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words array<long>")
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id", F.xxhash64("words")).limit(most).toArrow()
    return [x.values.to_numpy().astype(np.uint64) for x in rows["words"]]


def learn(docs: DataFrame, labels: DataFrame, known: Column, settings: Settings = Settings()) -> Model:
    """Train on bounded samples: only ``positives`` + ``unlabelled`` lists of word hashes reach the driver."""
    by_id = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & known)
             .groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic")))
    order = (F.xxhash64("doc_id", F.lit(12)), F.col("doc_id"))
    confirmed = by_id.where("toxic = 1").select("doc_id").orderBy(*order).limit(settings.positives)
    drawn = docs.where(F.col("doc_id").isNotNull() & known).select("doc_id").distinct().orderBy(*order).limit(settings.unlabelled)
    prior = by_id.agg(F.avg("toxic")).first()[0] or 0.0
    # both lists of ids are bounded by the settings: proven small
    positive = _texts(docs.join(F.broadcast(confirmed), "doc_id", "left_semi"), settings.positives, settings.words_per_text)
    unlabelled = _texts(docs.join(F.broadcast(drawn), "doc_id", "left_semi"), settings.unlabelled, settings.words_per_text)
    return train(positive, unlabelled, prior, settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row, in one pass without a shuffle."""
    shared, settings = docs.sparkSession.sparkContext.broadcast(model), model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch):
                s = shared.value.score(*distinct_words(piece.column("text")))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(s), pa.array((s >= settings.threshold).astype(np.int32))],
                                                 names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
