"""Operator 3, exact dedup: owners of equal texts from compressed radix tries.

Each task first folds its own rows, so a text copied a billion times leaves a task once. The different texts of each task
are dealt by length and content hash; a partition inserts the full byte strings into a Patricia trie whose terminal nodes
hold the owner, the rows and the rows of the owner's id. A trie over its memory limit spills whole subtrees to the task's
scratch folder and takes them up one by one. The owners of texts that occur more than once go back to the documents by
SHA-256 (an adaptive join, which splits hot keys).

Texts are equal when the same after lowering A-Z; null counts as empty. The owner is the largest identifier (or the
smallest). Edges: a null id never owns a text that has another id; rows that repeat an id and its text are all marked
kept by ``decisions``, and exactly one of them stays in ``without_copies``; empty tables give empty results; other columns pass.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import forget, free_names, slices

TRIE_BYTES = 96 << 20   # memory of one trie before it spills
PIECE_BYTES = 8 << 20   # text folded at once before the shuffle


def normalised(column: pa.Array) -> list[bytes]:
    """A-Z lowered, as UTF-8."""
    return [t.lower() for t in pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()]


def _shared(a: bytes, at: int, b: bytes) -> int:
    """How many bytes of ``b`` follow in ``a`` from ``at`` on."""
    low, high = 0, min(len(a) - at, len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[at + low: at + middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Owner:
    """What a terminal node knows: the best id, all rows, and the rows with that id."""

    __slots__ = ("best", "rows", "same")

    def __init__(self) -> None:
        self.best, self.rows, self.same = None, 0, 0

    def add(self, best: int | None, rows: int, same: int, better: Callable) -> None:
        if self.rows == 0 or (best is not None and (self.best is None or better(best, self.best) == best and best != self.best)):
            self.best, self.same = best, same
        elif best == self.best:
            self.same += same
        self.rows += rows


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.owner = label, {}, None


class Trie:
    """A Patricia trie of byte strings that all begin with ``prefix``."""

    def __init__(self, better: Callable = max, limit: int = TRIE_BYTES, prefix: bytes = b"") -> None:
        self.better, self.limit, self.prefix = better, limit, prefix
        self.root, self.held, self.spilled = Node(b""), {}, {}

    def insert(self, text: bytes, best: int | None, rows: int = 1, same: int = 1) -> None:
        at = len(self.prefix)
        first = text[at] if at < len(text) else -1
        if first in self.spilled:
            pickle.dump((text, best, rows, same), self.spilled[first])
            return
        node, added = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                added, at, node = added + len(child.label) + 400, len(text), child
                break
            label = child.label
            if text.startswith(label, at):
                at, node = at + len(label), child
                continue
            cut = _shared(text, at, label)
            upper = Node(label[:cut])
            upper.children[label[cut]] = child
            child.label = label[cut:]
            node.children[text[at]] = upper
            at, node, added = at + cut, upper, added + 400
        if node.owner is None:
            node.owner = Owner()
        node.owner.add(best, rows, same, self.better)
        if added:
            self.held[first] = self.held.get(first, 0) + added
            if sum(self.held.values()) > self.limit and first >= 0:
                self._spill(max((k for k in self.held if k >= 0), key=self.held.get))

    def _spill(self, first: int) -> None:
        """Write one subtree below the root to scratch; what comes for it later goes there too."""
        file = self.spilled[first] = tempfile.TemporaryFile()
        for text, owner in self._below(self.root.children.pop(first), self.prefix):
            pickle.dump((text, owner.best, owner.rows, owner.same), file)
        del self.held[first]

    @staticmethod
    def _below(top: Node, before: bytes) -> Iterator[tuple[bytes, Owner]]:
        stack = [(top, before)]
        while stack:
            node, path = stack.pop()
            path += node.label
            if node.owner is not None:
                yield path, node.owner
            stack.extend((child, path) for child in node.children.values())

    def owners(self) -> Iterator[tuple[bytes, Owner]]:
        for text, owner in self._below(self.root, self.prefix):
            yield text, owner
        self.root = Node(b"")
        for file in self.spilled.values():
            with file:
                shared = None
                for text, *_ in _read(file):
                    shared = text if shared is None else shared[: _shared(text, 0, shared)]
                part = Trie(self.better, self.limit, shared)
                for row in _read(file):
                    part.insert(*row)
                yield from part.owners()


def _read(file) -> Iterator[tuple]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and text_sha256 of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch, limit=PIECE_BYTES):
                sha = [hashlib.sha256(t).hexdigest() for t in normalised(piece.column("text"))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sha, pa.string())], names=["doc_id", "text_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text_sha256 string")


_FOLDED = pa.schema([("size", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("best", pa.int64()), ("rows", pa.int64()), ("same", pa.int64())])


def owners(docs: DataFrame, largest: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """text_sha256, keep_id, group_size and same (rows of keep_id) of every text that occurs more than once."""
    better = max if largest else min

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch, limit=PIECE_BYTES):
                trie = Trie(better)
                for text, doc in zip(normalised(piece.column("text")), piece.column("doc_id").to_pylist()):
                    trie.insert(text, doc)
                rows = [(len(t), xxhash.xxh64_intdigest(t) - 2**63, t, o.best, o.rows, o.same) for t, o in trie.owners()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOLDED)], schema=_FOLDED)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        trie = Trie(better, trie_bytes)
        for batch in batches:
            for text, best, rows, same in zip(*(batch.column(c).to_pylist() for c in ("text", "best", "rows", "same"))):
                trie.insert(text, best, rows, same)
        out: list[tuple] = []
        names = ["text_sha256", "keep_id", "group_size", "same"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for text, o in trie.owners():
            if o.rows > 1:
                out.append((hashlib.sha256(text).hexdigest(), o.best, o.rows, o.same))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    folded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        fold, "size long, hash long, text binary, best long, rows long, same long")
    return folded.repartition("size", "hash").mapInArrow(own, "text_sha256 string, keep_id long, group_size long, same long")


def decisions(docs: DataFrame, largest: bool = True) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    alone = F.col("group_size").isNull()
    return digests(docs).join(owners(docs, largest), "text_sha256", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, largest: bool = True) -> DataFrame:
    """The rows that stay, one of each text, with all their columns."""
    found = owners(docs, largest)
    sha, id_, tag = free_names(docs, "__sha", "__keep", "__same")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keyed = docs.withColumn(sha, F.sha2(F.translate(F.coalesce("text", F.lit("")), letters, letters.lower()), 256))
    marked = keyed.join(found.select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(id_), F.col("same").alias(tag)), sha, "left")
    stays = marked.where(F.col(tag).isNull() | F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    # rows that repeat the owner's id and text: one of them; all others pass without a second shuffle
    once = stays.where(F.coalesce(F.col(tag) == 1, F.lit(True)))
    repeated = stays.where(F.col(tag) > 1).dropDuplicates([sha])
    return once.unionByName(repeated).select(docs.columns)
