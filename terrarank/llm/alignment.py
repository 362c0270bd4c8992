"""Operator 13, cross-tokenizer alignment: hash-set intersection of cumulative ends.

Two tokenizers cut the same bytes. Per text, a dictionary of each side takes the byte at which a token ends to the token's
index; the keys that both hold, in ascending order, cut the two lists of ids into groups, and each group gives its links: the
pairs of tokens that end together. The dictionaries are Arrow's, so a very long text takes memory for a few numbers per token.

A link's two tokens end at the same byte, so one's bytes end with the other's. The pairs of ids for which that holds follow
from the two vocabularies alone, at most two for each byte of them (half a million here): links are kept as places in that
list, and the table of corpus-wide counts, made by summing counts per task, never has more rows, whatever the corpus. It is
small enough, by that bound, to go to every task, which then adds up the counts of a text's links.

Side A is a byte-level BPE file of the tokenizers library, side B a sentencepiece model whose dummy prefix stands for the
space put before the text on side A. Ordinary text (all characters below ``PLAIN``, at most ``SHORT`` of them) goes through
tiktoken with A's vocabulary as ranks, which gives the same ids five times as fast; all else goes through the library itself.

Edges: texts that are null or empty, or whose joined bytes on either side differ from space and text, have no tokens: zeros and
an empty ``groups_sha256``; strings of special tokens are ordinary text; repeated rows count each; a null doc_id stays null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .text import forget, kept, slices

PLAIN, SHORT = "\u0530", 1 << 16
_UNUSUAL = re.compile(f"[{PLAIN}-\U0010ffff]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(itself)]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Side A: ids and token bytes of a byte-level BPE file."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            special = {t["id"] for t in json.load(file).get("added_tokens", ())}
        letters = byte_letters()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.token = [b""] * (max(vocabulary.values()) + 1)
        for text, i in vocabulary.items():
            self.token[i] = text.encode() if i in special else bytes(letters[c] for c in text)
        ranks = {self.token[i]: i for i in vocabulary.values() if i not in special}
        self.fast = tiktoken.Encoding("side-a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(t) if len(t) <= SHORT and not _UNUSUAL.search(t)
                else self.library.encode_batch_fast([t], add_special_tokens=False)[0].ids for t in texts]


class Pieces:
    """Side B: ids and token bytes of a sentencepiece model."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        named = [self.library.id_to_piece(i) for i in range(n)]
        self.token = [bytes([int(p[1:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Pairs:
    """The pairs of ids whose tokens can end together, by number."""

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        of = [defaultdict(list), defaultdict(list)]
        for side, tokens in zip(of, (a, b)):
            for i, t in enumerate(tokens):
                if t:
                    side[t].append(i)
        found = {(i, j) for t, ids in of[0].items() for k in range(len(t)) if (js := of[1].get(t[k:])) for i in ids for j in js}
        found |= {(i, j) for t, ids in of[1].items() for k in range(1, len(t)) if (js := of[0].get(t[k:])) for i in js for j in ids}
        self.width = len(b)
        self.key = np.sort(np.array([i * self.width + j for i, j in found], np.int64))
        self.b = self.key % max(1, self.width)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, a.astype(np.int64) * self.width + b).astype(np.int32)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two ascending lists of ends at which both have the same one, in ascending order of the ends.

    Each side's ends become a dictionary to their places (Arrow's hash table), in which the other side's ends are looked up.
    """
    ends_a, ends_b = pa.array(a), pa.array(b)
    return (pc.drop_null(pc.index_in(ends_b, value_set=ends_a)).to_numpy().astype(np.int64),
            pc.drop_null(pc.index_in(ends_a, value_set=ends_b)).to_numpy().astype(np.int64))


class Letters:
    """Short byte strings by number, written one after another in whole lists."""

    def __init__(self, strings: list[bytes]) -> None:
        self.size = np.array([len(t) for t in strings])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def write(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[numbers] - ends + size, size)]


@dataclass(frozen=True)
class Groups:
    """The two lists of ids, the end of each group in them, and the links as places of their tokens in the two lists."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


class Aligner:
    def __init__(self, path_a: str, pattern: str, path_b: str) -> None:
        self.side_a, self.side_b = ByteLevel(path_a, pattern), Pieces(path_b)
        self.a, self.b = Letters(self.side_a.token), Letters(self.side_b.token)
        self.pairs = Pairs(self.side_a.token, self.side_b.token)
        # each id with what follows it: within a group, and at the end of its side of one
        self.written = Letters([b"%d%s" % (i, after) for side, ends in ((self.a, (b",", b"|")), (self.b, (b",", b";"))) for after in ends for i in range(len(side.size))])

    def align(self, texts: list[str | None]) -> Iterator[Groups | None]:
        """The groups of each text; None for one without tokens."""
        spaced = [" " + t if t else "" for t in texts]
        for whole, a, b in zip(spaced, self.side_a.encode(spaced), self.side_b.encode([t or "" for t in texts])):
            data, ids_a, ids_b = np.frombuffer(whole.encode(), np.uint8), np.array(a, np.int64), np.array(b, np.int64)
            if not len(data) or not np.array_equal(self.a.write(ids_a), data) or not np.array_equal(self.b.write(ids_b), data):
                yield None
                continue
            # ends are distinct on each side, so a slice's links are the pair of its last tokens
            last_a, last_b = common_ends(np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b]))
            yield Groups(ids_a, ids_b, last_a + 1, last_b + 1, last_a, last_b)

    def digest(self, g: Groups) -> str:
        """sha-256 of ``a1,a2|b1;a3|b2,b3``."""
        na, nb = len(self.a.size), len(self.b.size)
        code_a, code_b = g.a.copy(), g.b + 2 * na
        code_a[g.cut_a - 1] += na
        code_b[g.cut_b - 1] += nb
        out = np.empty(len(g.a) + len(g.b), np.int64)
        in_a, in_b = np.diff(g.cut_a, prepend=0), np.diff(g.cut_b, prepend=0)
        out[np.arange(len(g.a)) + np.repeat(g.cut_b - in_b, in_a)] = code_a
        out[np.arange(len(g.b)) + np.repeat(g.cut_a, in_b)] = code_b
        return hashlib.sha256(self.written.write(out)[:-1]).hexdigest()


def aligner(path_a: str, pattern: str, path_b: str) -> Aligner:
    """One per worker process, kept from task to task."""
    return kept((path_a, path_b), lambda: Aligner(path_a, pattern, path_b))


def groups(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """doc_id and the groups of every text, as an array of (a, b) id lists in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, pattern, path_b)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for piece in slices(batch):
                rows = []
                for g in own.align(piece.column("text").to_pylist()):
                    rows.append([] if g is None else [{"a": x, "b": y} for x, y in zip(np.split(g.a, g.cut_a[:-1]), np.split(g.b, g.cut_b[:-1]))])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def _linked(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and links: 32-bit numbers of pairs, in the order of the text."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, pattern, path_b)
        for batch in batches:
            for piece in slices(batch):
                rows = [(0, 0, 0, "", b"") if g is None else
                        (len(g.a), len(g.b), len(g.cut_a), own.digest(g), own.pairs.number(g.a[g.link_a], g.b[g.link_b]).tobytes())
                        for g in own.align(piece.column("text").to_pylist())]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair and n: links of the corpus per pair that has one; a row per pair and task is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                now = np.bincount(np.frombuffer(b"".join(batch.column("links").slice(a, 1024).to_pylist()), np.int32))
                if len(now) > len(total):
                    total = np.concatenate((total, np.zeros(len(now) - len(total), np.int64)))
                total[: len(now)] += now
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])

    return linked.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def summary(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    linked = durable(_linked(docs, path_a, pattern, path_b))
    pairs = Aligner(path_a, pattern, path_b).pairs
    count = np.zeros(len(pairs.key), np.int64)
    for r in pair_counts(linked).toLocalIterator():   # no more rows than the vocabularies have pairs
        count[r.pair] = r.n
    highest = np.zeros(pairs.width, np.int64)
    np.maximum.at(highest, pairs.b, count)
    known = docs.sparkSession.sparkContext.broadcast((count, (count > 0) & (count == highest[pairs.b])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts, best = known.value
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("links")]
            more = [[len(f) for f in found], [int(best[f].sum()) for f in found], [int(counts[f].sum()) for f in found]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *(pa.array(c, pa.int64()) for c in more), batch.column("groups_sha256")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return linked.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
