"""Operator 7, token ids in binary: Elias-Fano coded document boundaries over one array of ids.

Documents are put in ascending order of doc_id by range partitions; each partition tokenises its texts and writes
segments of about ``SEGMENT_IDS`` ids, whatever its size. A segment is one byte string with a header, the ids (two bytes
each where the vocabulary allows), and two Elias-Fano lists, the ends of the documents and their doc_ids: low bits packed,
high bits in unary, and the place of every ``SAMPLE``-th of these so that ``select`` finds any document without a table of
64-bit offsets. Segments are rows of Parquet files, so any store that Spark writes can hold them and a lost task leaves
nothing behind. Ids before a segment: those before it in its partition, and a running sum over the partitions (one row
each), kept beside the segments.

Edges: null text is empty text and has the end id alone; a null doc_id comes first; repeated ids follow each other in the
order of a hash of their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_checked
from .text import CHUNK, LOWER, as_bytes, kept, slices

SEGMENT_IDS = 1 << 20
SAMPLE = 256
PIECES_KEPT = 1_600_000   # pieces whose ids a worker remembers at most

_ROW = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("before", pa.int64()), ("documents", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])
_HEADER = struct.Struct("<4sBxxxQQQ")   # mark, bytes per id, documents, ids, documents without doc_id
_LIST = struct.Struct("<QQBxxxxxxx")    # numbers, smallest, low bits


class EliasFano:
    """Ascending numbers in about 2 + log2(range / count) bits each."""

    def __init__(self, count: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray) -> None:
        self.count, self.base, self.low_bits, self.low, self.high, self.sample = count, base, low_bits, low, high, sample

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        n = len(numbers)
        base = int(numbers[0]) if n else 0
        rest = (numbers.astype(np.int64) - base).view(np.uint64) if n else np.zeros(0, np.uint64)
        top = int(rest[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1) if top > n else 0
        low = np.zeros(0, np.uint8)
        if bits and n:
            shifts = np.arange(bits, dtype=np.uint64)
            low = np.packbits(((rest[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        ones = (rest >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, base, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def pack(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.sample.tobytes()]
        sizes = struct.pack("<QQQ", *map(len, parts))
        return _LIST.pack(self.count, self.base & (2**64 - 1), self.low_bits) + sizes + b"".join(parts)

    @classmethod
    def unpack(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        count, base, bits = _LIST.unpack_from(data)
        sizes = struct.unpack_from("<QQQ", data, _LIST.size)
        at, parts = _LIST.size + 24, []
        for size, kind in zip(sizes, (np.uint8, np.uint8, np.uint32)):
            parts.append(np.frombuffer(data[at: at + size], kind))
            at += size
        return cls(count, base - (base >> 63 << 64), bits, *parts), data[at:]

    def _low(self, k: int) -> int:
        a = k * self.low_bits
        whole = int.from_bytes(self.low[a // 8: (a + self.low_bits + 7) // 8].tobytes(), "little")
        return (whole >> (a % 8)) & ((1 << self.low_bits) - 1)

    def select(self, k: int) -> int:
        """The k-th number, from the nearest sampled place on."""
        place = int(self.sample[k // SAMPLE])
        left, byte = k % SAMPLE, place // 8
        bits = int(self.high[byte]) >> (place % 8) << (place % 8)
        while (ones := bits.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        return self.base + (((place - k) << self.low_bits) | self._low(k))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        out = (ones - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.count:
            bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits].reshape(self.count, self.low_bits)
            for j in range(self.low_bits):
                out |= bits[:, j].astype(np.uint64) << np.uint64(j)
        return out.view(np.int64) + self.base


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    nulls = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    return (_HEADER.pack(b"EFID", width, len(doc_ids), len(ids), nulls) + EliasFano.of(np.cumsum(lengths)).pack()
            + EliasFano.of(known).pack() + ids.astype(np.dtype(f"<u{width}")).tobytes())


class Segment:
    def __init__(self, data: bytes) -> None:
        view = memoryview(data)
        mark, width, self.documents, self.size, self.nulls = _HEADER.unpack_from(view)
        if mark != b"EFID":
            raise ValueError("not a segment of token ids")
        self.ends, view = EliasFano.unpack(view[_HEADER.size:])
        self.known, view = EliasFano.unpack(view)
        self.ids = np.frombuffer(view, np.dtype(f"<u{width}"), self.size)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.ids[self.ends.select(k - 1) if k else 0: self.ends.select(k)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + self.known.all().tolist()


# Bytes by what the patterns make of them: a space or line end, a letter, a mark other than the apostrophe, a digit, and all else
_SPACE, _LETTER, _MARK, _DIGIT, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK
_KIND[ord("'")] = _OTHER
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[[10, 32]] = _DIGIT, _LETTER, _LETTER, _SPACE


# The normaliser, patterns and mark of a word's end for which words between spaces stand alone
_WORDWISE = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "</w>")


class Tokenizer:
    """The tokenizers library's ids of whole texts, with the pieces that came before looked up.

    Where the file's normaliser and patterns are ``_WORDWISE``, they never look across a space or line end, so a text's ids are
    those of its words between them. Words of ASCII and Latin-1 letters, digits and marks fall into runs of letters, runs of
    marks and single digits, each in lower case and for itself; all other words are pieces as they are. Each piece that a chunk
    holds is looked up once a chunk. Texts that hold the string of an added token, and all texts under another file, go
    to the library whole. New pieces go to the library together: plain ones many to a text, cut up again at the tokens that end a word, all others
    each for itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        suffix = file["model"].get("end_of_word_suffix")
        tokens = file.get("added_tokens") or ()
        self.added = [t["content"] for t in tokens]
        ways = (file.get("normalizer"), file.get("pre_tokenizer"), suffix)
        # strings that are looked for after the text is normalised, or that spaces cut, are not found in the text as it is
        self.apart = ways == _WORDWISE and not any(t["normalized"] or re.search(r"\s", t["content"]) for t in tokens)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.newer: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        groups = [words[i: i + 1000] for i in range(0, len(words), 1000)]
        for group, e in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts)] if len(cuts) == len(group) else self._alone(group)
        return out

    def _look(self, pieces: list[bytes], other: list[bool]) -> list[bytes]:
        """The ids of different pieces. A full newer table becomes the older one."""
        out = list(map(self.newer.get, pieces))
        gaps = [i for i, ids in enumerate(out) if ids is None]
        for i in gaps:
            out[i] = self.older.get(pieces[i])
        new = [i for i in gaps if out[i] is None]
        for encode, at in ((self._together, [i for i in new if not other[i]]), (self._alone, [i for i in new if other[i]])):
            for i, ids in zip(at, encode([pieces[i].decode() for i in at])):
                out[i] = ids
        kept = {pieces[i]: out[i] for i in gaps if len(pieces[i]) <= 64}
        if len(self.newer) + len(kept) > PIECES_KEPT // 2:
            self.newer, self.older = kept, self.newer
        else:
            self.newer.update(kept)
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is empty text."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        whole = np.full(len(texts), not self.apart)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_pieces(texts)
        found = iter(self._alone(texts.filter(pa.array(whole)).to_pylist()))
        rest = iter(self._by_pieces(texts.filter(pa.array(~whole))))
        return [np.frombuffer(next(found), self.kind) if w else next(rest) for w in whole]

    def _by_pieces(self, texts: pa.Array) -> list[np.ndarray]:
        data, offsets = as_bytes(texts)
        if not len(data):
            return [np.zeros(0, self.kind)] * len(texts)
        kinds, low = _KIND[data], LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)   # two bytes of À to ÿ
        second = data[lead + 1]
        lead, second = (x[(second & 0xC0 == 0x80) & (second != 0x97) & (second != 0xB7)] for x in (lead, second))   # but not × and ÷
        kinds[lead] = kinds[lead + 1] = _LETTER
        low[lead + 1] = np.where(second <= 0x9E, second | 0x20, second)
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        if (others := np.flatnonzero(kinds == _OTHER)).size:
            gap = kinds == _SPACE
            begins = ~gap
            begins[1:] &= gap[:-1]
            begins[first] = ~gap[first]
            start = np.flatnonzero(begins)
            word = np.unique(np.searchsorted(start, others, side="right") - 1)
            mine = np.zeros(len(start), bool)
            mine[word] = True
            mine = np.repeat(mine, np.diff(start, append=len(data)))   # with the spaces after a word
            at = np.flatnonzero(mine & ~gap[start[0]:]) + start[0]
            kinds[at], low[at] = _OTHER, data[at]
        begins = np.ones(len(data), bool)
        begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        begins[first] = True
        inside = kinds != _SPACE
        begins &= inside
        start, low, edges = np.flatnonzero(begins), low[inside], np.flatnonzero(begins[inside])
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(edges, len(low))), pa.py_buffer(low)]).dictionary_encode()
        at = pieces.indices.to_numpy()
        other = np.zeros(len(pieces.dictionary), bool)
        other[at[kinds[start] == _OTHER]] = True
        ids = pa.array(self._look(pieces.dictionary.to_pylist(), other.tolist()), pa.large_binary()).take(pieces.indices)
        _, ends, flat = ids.buffers()
        cuts = np.frombuffer(ends, np.int64)[: len(ids) + 1][np.searchsorted(start, offsets)] // self.kind.itemsize
        flat = np.frombuffer(flat or b"", np.uint8).view(self.kind)
        return [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def tokenizer(path: str) -> Tokenizer:
    """One per worker process, its words kept from task to task."""
    return kept(path, lambda: Tokenizer(path))


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Write ``folder``/segments and ``folder``/starts."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        doc_ids, lengths, ids, held, before, number = [], [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, ids, held, before, number
            data = pack_segment(doc_ids, lengths, np.concatenate(ids), own.kind.itemsize)
            row = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, number, before, len(doc_ids), held, data), _ROW)], schema=_ROW)
            before, number = before + held, number + 1
            doc_ids, lengths, ids, held = [], [], [], 0
            return row

        end = np.array([] if end_id is None else [end_id], own.kind)
        for batch in batches:
            for piece in slices(batch, limit=4 * CHUNK):
                for doc, found in zip(piece.column("doc_id").to_pylist(), own.encode(piece.column("text"))):
                    doc_ids.append(doc)
                    lengths.append(len(found) + len(end))
                    ids += [found, end]
                    held += lengths[-1]
                    if held >= segment_ids:
                        yield segment()
        if doc_ids:
            yield segment()

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    ordered.mapInArrow(run, "part int, number int, before long, documents long, size long, data binary").write.parquet(f"{folder}/segments")
    parts = spark.read.parquet(f"{folder}/segments").groupBy("part").agg(F.sum("size").alias("size"))
    # one row per partition, however large the partitions are
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("size").over(order), F.lit(0).cast("long")).alias("start")).write.parquet(f"{folder}/starts")


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    starts = broadcast_checked(spark.read.parquet(f"{folder}/starts"))
    return (spark.read.parquet(f"{folder}/segments").join(starts, "part")
            .select((F.col("start") + F.col("before")).alias("start"), "data"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                s = Segment(data.as_buffer())
                ends = s.ends.all()
                begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                at = pa.array(np.concatenate((begins[:1], ends)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids(), pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.ListArray.from_arrays(at, pa.array(s.ids.astype(np.int32)))],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return _segments(spark, folder).mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as 32-bit little-endian numbers, of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                s = Segment(data.as_buffer())
                ends, wide = s.ends.all(), memoryview(s.ids.astype("<u4").tobytes())
                begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                crc = [zlib.crc32(wide[4 * a: 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids(), pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _segments(spark, folder).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
