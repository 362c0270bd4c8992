"""Operator 1, quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Fit: a bounded sample of labelled rows (``Settings.neighbours``) becomes term vectors (hashed words, hashed word shapes, and
soft bins of whole-text measures such as the share of repeated words); a truncated SVD of that matrix gives the latent
space. Their latent vectors are broadcast: at most ``neighbours`` x ``rank`` floats. Score: every whole text is brought
into the same space, its cosines to all labelled vectors are computed in blocks (exact, no index), and the labels of the
nearest ``voters`` are averaged, weighted by a power of the cosine.

Edges: null text is empty text and gets a score like any other (its vector is zero, so all voters weigh the same: the
share of label 1 in the sample); no labelled row at all gives 0.5 everywhere; labels that disagree on one doc_id are
averaged; rows with a null label or doc_id teach nothing; repeated rows get a row each; ties among neighbours go to the
first of the sample; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words, as_bytes, forget, mix, shingles, slices

SHAPES, WORDS, BINS = 1024, 2816, 16


@dataclass(frozen=True)
class Settings:
    neighbours: int = 4096   # most labelled rows that are kept, and broadcast
    rank: int = 64           # size of the latent space
    voters: int = 16         # nearest labelled vectors that vote
    power: float = 8.0       # weight of a vote: cosine to this power
    threshold: float = 0.3   # predicted is 1 from this score on
    block: int = 512         # documents per block of cosines


_KIND = np.zeros(256, dtype=np.uint64)  # a byte's kind: lower, upper, digit, other letter, or the mark itself
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _b >= 128 else 8 + _b
MEASURES = 10
TERMS = SHAPES + WORDS + MEASURES * BINS


def measures(w: Words, data: np.ndarray) -> np.ndarray:
    """Ten shares between 0 and 1 of each whole text."""
    n, size = w.rows, np.maximum(1, np.diff(w.offsets))
    row = np.repeat(np.arange(n), np.diff(w.offsets))
    kind = _KIND[data]
    share = lambda mask: np.bincount(row[mask], minlength=n) / size
    upper, lower = share(kind == 2), share(kind == 1)
    words = np.maximum(1, w.count)
    per_word = lambda mask: np.bincount(w.doc[mask], minlength=n) / words
    order = np.lexsort((w.hash, w.doc))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    distinct = np.bincount(w.doc[order][new], minlength=n)
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    sh, at = shingles(w)
    order = np.lexsort((sh, at))
    new = np.ones(len(order), bool)
    new[1:] = (sh[order][1:] != sh[order][:-1]) | (at[order][1:] != at[order][:-1])
    runs = np.bincount(at[order][new], minlength=n) / np.maximum(1, np.bincount(at, minlength=n))
    length = (w.end - w.start).astype(float)
    last = kind[w.end - 1] if len(w.end) else kind[:0]
    return np.stack([
        distinct / words, runs, upper / np.maximum(upper + lower, 1e-9), share(kind == 3), share(kind >= 8 + 33),
        per_word(last >= 8 + 33), per_word(again), np.minimum(1, np.bincount(w.doc, length, minlength=n) / words / 16),
        np.minimum(1, np.log2(1 + w.count) / 16), per_word(length == 1)], axis=1)


def term_matrix(column: pa.Array) -> np.ndarray:
    """One row of term weights per text, each of the three kinds of terms at unit length: ``rows`` x ``TERMS``."""
    data, offsets = as_bytes(column)
    w = Words(data, offsets)
    out = np.zeros((w.rows, TERMS), np.float32)
    if len(w.hash):
        first, last, size = _KIND[data[w.start]], _KIND[data[w.end - 1]], np.minimum(7, (w.end - w.start) // 2).astype(np.uint64)
        second = _KIND[data[np.minimum(w.start + 1, w.end - 1)]]
        shape = mix(first + second * np.uint64(300) + last * np.uint64(90_000) + size * np.uint64(27_000_000)) % np.uint64(SHAPES)
        word = w.hash % np.uint64(WORDS) + np.uint64(SHAPES)
        for term in (shape, word):
            cell = w.doc * TERMS + term.astype(np.int64)
            which, times = np.unique(cell, return_counts=True)
            out.reshape(-1)[which] = np.sqrt(times)
    for a, b in ((0, SHAPES), (SHAPES, SHAPES + WORDS)):
        out[:, a:b] /= np.maximum(1e-9, np.linalg.norm(out[:, a:b], axis=1, keepdims=True))
    at = measures(w, data) * (BINS - 1)
    low = np.minimum(at.astype(int), BINS - 2)
    some = (w.count > 0)[:, None]
    cell = SHAPES + WORDS + np.arange(MEASURES) * BINS + low
    np.put_along_axis(out, cell, (some * (1 - (at - low)) / MEASURES ** 0.5).astype(np.float32), axis=1)
    np.put_along_axis(out, cell + 1, (some * (at - low) / MEASURES ** 0.5).astype(np.float32), axis=1)
    return out


@dataclass
class Model:
    basis: np.ndarray     # TERMS x rank
    vectors: np.ndarray   # labelled rows x rank, unit length
    labels: np.ndarray
    settings: Settings

    def latent(self, terms: np.ndarray) -> np.ndarray:
        v = terms @ self.basis
        return v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))

    def score(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        k, v = min(self.settings.voters, len(self.labels)), self.latent(terms)
        cosine = v @ self.vectors.T
        if k < len(self.labels):
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            cosine, labels = np.take_along_axis(cosine, near, axis=1), self.labels[near]
        else:
            labels = np.broadcast_to(self.labels, cosine.shape)
        weight = np.maximum(cosine, 0).astype(float) ** self.settings.power + 1e-12
        return np.where(np.any(v != 0, axis=1), (weight * labels).sum(1) / weight.sum(1), self.labels.mean())


def fit(terms: np.ndarray, labels: np.ndarray, settings: Settings) -> Model:
    """Truncated SVD by subspace iteration, then the labelled rows' own latent vectors."""
    if not len(labels):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, settings)
    rank = min(settings.rank, len(labels))
    present = (terms > 0).sum(0)
    weight = np.log((1 + len(labels)) / (1 + present)).astype(np.float32) + 1
    a = terms * weight
    q = np.random.default_rng(1).standard_normal((a.shape[1], rank + 8)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(a.T @ (a @ q))[0]
    _, s, vt = np.linalg.svd(a @ q, full_matrices=False)
    basis = (weight[:, None] * (q @ vt.T[:, :rank])).astype(np.float32)
    model = Model(basis, np.zeros((0, rank), np.float32), labels, settings)
    model.vectors = model.latent(terms).astype(np.float32)
    return model


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Rows whose crc32 of the id as text leaves ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled(labels: DataFrame, label: str, known: Column, most: int) -> DataFrame:
    """(doc_id, label) of at most ``most`` labelled ids, the first by a hash of the id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & known)
    return (rows.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("label"))
            .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most))


def learn(docs: DataFrame, labels: DataFrame, known: Column, settings: Settings = Settings()) -> Model:
    """Fit on the sampled labelled rows. Only they reach the driver: ``neighbours`` rows of compressed terms."""
    sample = labelled(labels, "quality", known, settings.neighbours)
    # at most ``neighbours`` rows of two numbers: proven small
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch):
                m = term_matrix(piece.column("text"))
                cells = [np.flatnonzero(r) for r in m]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("label"), pa.array([c.astype(np.int32) for c in cells], pa.list_(pa.int32())),
                     pa.array([r[c] for r, c in zip(m, cells)], pa.list_(pa.float32()))], names=["doc_id", "label", "terms", "weights"])

    rows = texts.select("doc_id", "label", "text").mapInArrow(sparse, "doc_id long, label double, terms array<int>, weights array<float>")
    # repeated ids may bring more rows than labels: the first by id and content fill the bound
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", F.xxhash64("terms", "weights")).limit(settings.neighbours).toArrow()
    terms = np.zeros((rows.num_rows, TERMS), np.float32)
    for i, (t, x) in enumerate(zip(rows["terms"], rows["weights"])):
        terms[i, t.values.to_numpy()] = x.values.to_numpy()
    return fit(terms, rows["label"].to_numpy(), settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row, in one pass without a shuffle."""
    shared, settings = docs.sparkSession.sparkContext.broadcast(model), model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch):
                for a in range(0, piece.num_rows, settings.block):
                    part = piece.slice(a, settings.block)
                    s = shared.value.score(term_matrix(part.column("text")))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= settings.threshold).astype(np.int32))],
                                                     names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text isn't rejected, with all their columns, in one pass without a shuffle."""
    shared, settings = docs.sparkSession.sparkContext.broadcast(model), model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch):
                for a in range(0, piece.num_rows, settings.block):
                    part = piece.slice(a, settings.block)
                    yield part.filter(pa.array(shared.value.score(term_matrix(part.column("text"))) >= settings.threshold))

    return docs.mapInArrow(run, docs.schema)
