"""Operator 4, byte-level BPE encoding and decoding.

Encoding is a finite-state transducer that is made deterministic as text needs it. A sequence of tokens is what the merges
make of its bytes exactly if every pair of neighbours is (Berglund and van der Merwe, "Formalizing BPE tokenization"), so
each prefix of a piece has one tokenisation, and a later one can only leave it at a boundary from which the bytes read so
far begin some token. A state is the bytes since the last emitted token; reading a byte emits the tokens on which all such
open boundaries agree, so what is held is about as long as the longest token. States are kept in a table of
bounded size; when it is full, those from which several bytes went on stay. Pieces and space-separated runs of text that came before are looked up.

Decoding streams: token bytes go through an incremental UTF-8 machine (``codecs``), so a character that is spread over
tokens, or over blocks of them, comes out when its last byte has; bytes that are no UTF-8 become U+FFFD.

Edges: null text is empty text and has no tokens; strings that look like special tokens are ordinary text; very long pieces
take memory for their bytes and tokens only; repeated rows get a row each; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import kept, slices

STATES, PAIRS, PIECES, RUNS = 100_000, 300_000, 160_000, 240_000   # most entries of each table of a worker
DECODED_AT_ONCE = 4096                             # tokens per block of streaming decode

_WHITE = "\t-\r \x85\xa0  -     　"
_GAP = re.compile(f"([{_WHITE}]{{2,}})")


def load_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


_ONE = [bytes([b]) for b in range(256)]


class State:
    """Bytes ``held`` since the last emitted token, the ``token`` that ends at each position of them, and where a token may begin."""

    __slots__ = ("held", "token", "open", "next", "end")

    def __init__(self, held: bytes, token: tuple[int, ...], open_: list[int]) -> None:
        self.held, self.token, self.open = held, token, open_
        self.next: dict[int, tuple[tuple[int, ...], State]] = {}
        self.end: tuple[int, ...] | None = None


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = STATES) -> None:
        self.ranks, self.most = ranks, most_states
        self.bytes = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.begun = {t[:i] for t in ranks for i in range(1, len(t))}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self._empty()

    def _empty(self) -> None:
        self.start, self.states = State(b"", (-1,), [0]), {}

    def _shrink(self) -> None:
        """Keep the states that texts share, those from which several bytes went on; of the chains behind them nothing stays."""
        least, keep = 2, self.states
        while len(keep) > self.most // 2:
            keep = {held: s for held, s in keep.items() if len(s.next) >= least}
            least += 1
        for s in (self.start, *keep.values()):
            s.next = {byte: move for byte, move in s.next.items() if move[1] is self.start or keep.get(move[1].held) is move[1]}
        self.states = keep

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            parts = [self.ranks[bytes([b])] for b in self.bytes[token]]
            while len(parts) > 2:
                merged = [self.ranks.get(self.bytes[a] + self.bytes[b], 1 << 60) for a, b in zip(parts, parts[1:])]
                i = merged.index(min(merged))
                parts[i: i + 2] = [merged[i]]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def _neighbours(self, left: int, right: int) -> bool:
        """Do the merges leave the boundary between two tokens alone?

        Goes back in time from the finished tokens. What stands on either side of the boundary stood there until the
        younger of the two was made; had the pair a merge before that, it would have closed the boundary. Of merges with the
        same rank the one further left comes first.
        """
        key = (left, right)
        if key not in self.fits:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            until, side, fits = 1 << 60, 0, True   # the merge undone last, and whether it was on the left (0) or the right (2)
            ranks, token, halves = self.ranks, self.bytes, self.halves
            while True:
                merged = ranks.get(token[left] + token[right])
                if merged is not None and (merged < until or (merged == until and side == 2)):
                    fits = False
                    break
                a = halves[left] if left in halves else self._split(left)
                b = halves[right] if right in halves else self._split(right)
                if a is None and b is None:
                    break
                # the later of the two merges is undone; of equal ranks the right one came later
                if b is None or (a is not None and left > right):
                    until, side, left = left, 0, a[1]
                else:
                    until, side, right = right, 2, b[0]
            self.fits[key] = fits
        return self.fits[key]

    def _step(self, state: State, byte: int) -> tuple[tuple[int, ...], State]:
        held, token, size = state.held + _ONE[byte], state.token, self.size
        ranks, begun, fits, made = self.ranks, self.begun, self.fits, -1
        open_ = [i for i in state.open if held[i:] in begun]
        for i in reversed(state.open):
            # one token fits, and only one: if no later beginning does, it begins where the last emitted one ended
            rank = ranks.get(held[i:])
            if rank is not None:
                fit = i == 0 or fits.get((token[i], rank))
                if fit or (fit is None and self._neighbours(token[i], rank)):
                    made = rank
                    break
        token += (made,)
        open_.append(len(held))
        # the last boundary through which the tokenisations up to all open positions pass
        cut = open_[0]
        for i in open_[1:]:
            while i != cut:
                if i > cut:
                    i -= size[token[i]]
                else:
                    cut -= size[token[cut]]
        out = ()
        if cut:
            i = cut
            while i:
                out = (token[i], *out)
                i -= size[token[i]]
            held, open_ = held[cut:], [i - cut for i in open_]
        after = self.states.get(held)
        if after is None:
            if len(self.states) >= self.most:
                self._shrink()
            after = self.states[held] = State(held, token[cut:], open_)
        move = state.next[byte] = out, after
        return move

    def _finish(self, state: State) -> tuple[int, ...]:
        out, i = [], len(state.held)
        while i > 0:
            out.append(state.token[i])
            i -= self.size[state.token[i]]
        state.end = tuple(reversed(out))
        return state.end

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one piece, each as soon as no further byte can change it."""
        state = self.start
        for byte in data:
            move = state.next.get(byte) or self._step(state, byte)
            yield from move[0]
            state = move[1]
        yield from state.end if state.end is not None else self._finish(state)

    def piece(self, data: bytes) -> tuple[int, ...]:
        out, state, step = [], self.start, self._step
        for byte in data:
            move = state.next.get(byte) or step(state, byte)
            if move[0]:
                out += move[0]
            state = move[1]
        out += state.end if state.end is not None else self._finish(state)
        return tuple(out)


class Seen(dict):
    """Ids (32 bits each) of short strings that came before, in two generations: the older one goes when the newer is full."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most, self.older = make, most // 2, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.make(text)
        if len(text) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        ranks = load_ranks(ranks_path)
        self.machine = Transducer(ranks)
        self.match = regex.compile(pattern).findall
        pieces = Seen(lambda piece: array("I", self.machine.piece(piece.encode())).tobytes(), PIECES)
        self.runs = Seen(lambda run: b"".join(map(pieces.__getitem__, self.match(run))), RUNS)
        self.token = [self.machine.bytes.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self.decimal = [str(i).encode() for i in range(len(self.token))]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.runs.__getitem__, self._cut(text))), np.uint32)

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Runs that the pattern never matches across: cut before each space that stands between two other characters.

        Of longer white space all but the last character are a run (all, at the end of the text); the last one begins the
        next run.
        """
        parts, before, out = _GAP.split(text), "", []
        for i in range(0, len(parts), 2):
            words = (before + parts[i]).split(" ")
            out.append(words[0])
            out += [" " + word for word in words[1:]]
            if i + 1 < len(parts):
                gap = parts[i + 1]
                before = gap[-1] if parts[i + 2] else ""
                out.append(gap[:-1] if before else gap)
        return out

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        """Text in blocks, in streaming fashion."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for a in range(0, len(ids), DECODED_AT_ONCE):
            yield machine.decode(b"".join(map(self.token.__getitem__, ids[a: a + DECODED_AT_ONCE].tolist())))
        yield machine.decode(b"", final=True)

    def digest(self, ids: np.ndarray) -> str:
        return hashlib.sha256(b",".join(map(self.decimal.__getitem__, ids.tolist()))).hexdigest()


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec per worker process, its tables kept from task to task."""
    return kept((ranks_path, pattern), lambda: Codec(ranks_path, pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ids and n_tokens of every row."""
    columns = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for piece in slices(batch):
                ids = [own.encode(t or "") for t in piece.column("text").to_pylist()]
                at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(np.diff(at).astype(np.int64))],
                    names=[*keep, "ids", "n_tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return columns.mapInArrow(run, f"{kinds}, ids array<int>, n_tokens long")


def decode(tokens: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and text of rows with ``ids``; null ids are no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                text = ["".join(own.decode(np.asarray(x or [], np.uint32))) for x in piece.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(text, pa.string())], names=[*keep, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*keep).schema)
    return tokens.select(*keep, "ids").mapInArrow(run, f"{kinds}, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text decoded from them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for piece in slices(batch):
                rows = []
                for text in piece.column("text").to_pylist():
                    ids, back = own.encode(text or ""), hashlib.sha256()
                    for block in own.decode(ids):
                        back.update(block.encode())
                    rows.append((len(ids), own.digest(ids), back.hexdigest()))
                n, ids_sha, text_sha = zip(*rows)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
