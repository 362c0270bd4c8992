"""Operator 5, secret scans: a trigram inverted index in front of regular expressions.

From each rule's regular expression follows a Boolean query of trigrams that every match must contain. Blocks of whole texts
are indexed (lower-cased trigram to the rows that hold it, for the trigrams that rules ask for); postings are intersected
and united as the query says, and only those rows are searched. A rule without a mandatory trigram searches every row.

Spans are code points, end exclusive. Edges: null text is empty text and has no spans; empty rows get the digest of an
empty list; repeated rows get a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product
from re import _constants as kinds
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, as_bytes, forget, slices

FEW = 64   # most strings of a part of a rule that are followed one by one


@dataclass(frozen=True)
class Query:
    """``every``: trigrams that must all be there; ``some``: groups of queries of which one must hold. Nothing: any text."""

    every: frozenset[str] = frozenset()
    some: tuple[tuple[Query, ...], ...] = ()

    @property
    def anything(self) -> bool:
        return not self.every and not self.some

    def __and__(self, other: Query) -> Query:
        return Query(self.every | other.every, self.some + other.some)

    def trigrams(self) -> set[str]:
        return set(self.every).union(*(q.trigrams() for group in self.some for q in group))


def either(queries: list[Query]) -> Query:
    if any(q.anything for q in queries):
        return Query()
    # a way that asks for more than another adds nothing
    ways = [q for q in dict.fromkeys(queries) if not any(o != q and not o.some and o.every < q.every and not q.some for o in queries)]
    return ways[0] if len(ways) == 1 else Query(some=(tuple(ways),))


def of_strings(strings: set[str]) -> Query:
    return either([Query(frozenset(s[i: i + 3] for i in range(len(s) - 2))) for s in sorted(strings)])


def _class(items: list) -> set[str] | None:
    """The characters of a class, lower-cased, when they are few."""
    out: set[str] = set()
    for kind, value in items:
        if kind is kinds.LITERAL:
            out.add(chr(value).lower())
        elif kind is kinds.RANGE and value[1] - value[0] < FEW:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(parsed) -> tuple[set[str] | None, Query]:
    """All strings a part can match, if they are few, and else what it needs."""
    run, query, whole = {""}, Query(), True

    def end_run() -> None:
        nonlocal run, query, whole
        query, run, whole = query & of_strings(run), {""}, False

    for kind, value in parsed:
        strings, needs = None, Query()
        if kind is kinds.LITERAL:
            strings = {chr(value).lower()}
        elif kind is kinds.IN:
            strings = _class(value)
        elif kind is kinds.AT:
            strings = {""}
        elif kind is kinds.SUBPATTERN:
            strings, needs = _walk(value[3])
        elif kind is kinds.BRANCH:
            ways = [_walk(v) for v in value[1]]
            if all(s is not None for s, _ in ways):
                strings = set().union(*(s for s, _ in ways))
            needs = either([of_strings(s) if s is not None else q for s, q in ways])
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
            least, most, inner = value
            one, inside = _walk(inner)
            if one is not None and most == 1:
                strings = one | {""} if least == 0 else one
            elif least > 0:
                needs = of_strings(one) if one is not None else inside
        if strings is not None and len(run) * len(strings) <= FEW:
            run = {a + b for a, b in product(run, strings)}
        elif strings is not None and len(strings) <= FEW:
            end_run()
            run = strings
        else:
            end_run()
            query = query & (of_strings(strings) if strings is not None else needs)
    if whole:
        return run, of_strings(run)
    end_run()
    return None, query


def trigram_query(pattern: str, flags: int = 0) -> Query:
    strings, query = _walk(parser.parse(pattern, flags))
    return of_strings(strings) if strings is not None else query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    passes: Callable[[re.Match], bool] = field(default=lambda m: True)
    base: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.ignore_case else 0)


# The kinds and patterns of the base spans, in the order in which they are listed. A run of hexadecimal digits
# is taken whole, so its least length can stand in the pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, lambda m: len(m[2]) >= 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", False, lambda m: len(m[0]) >= 20, True),
    Rule("hex", r"[0-9a-f]{24,}", False, lambda m: True, True),
)
# Public formats of keys.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("git_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{24,}"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]
        wanted = sorted({t for _, _, q in self.rules for t in q.trigrams() if t.isascii()})
        self.code = {t: (ord(t[0]) << 16) | (ord(t[1]) << 8) | ord(t[2]) for t in wanted}
        self.asked = np.zeros(1 << 24, bool)
        self.asked[list(self.code.values())] = True

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Rows that hold each asked trigram, ascending."""
        low = LOWER[data].astype(np.uint32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(self.asked[codes])
        row = np.searchsorted(offsets[1:], at, side="right")
        inside = at + 2 < offsets[row + 1]
        pairs = np.unique(np.stack((codes[at[inside]].astype(np.int64), row[inside]), axis=1), axis=0)
        cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
        return {int(p[0, 0]): p[:, 1] for p in np.split(pairs, cuts) if len(p)}

    def rows(self, query: Query, postings: dict[int, np.ndarray], everything: np.ndarray) -> np.ndarray:
        found, none = everything, np.zeros(0, np.int64)
        for t in query.every:
            if t in self.code:
                found = np.intersect1d(found, postings.get(self.code[t], none), assume_unique=True)
        for group in query.some:
            one = np.unique(np.concatenate([self.rows(q, postings, everything) for q in group]))
            found = np.intersect1d(found, one, assume_unique=True)
        return found

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each row, in order."""
        data, offsets = as_bytes(column)
        postings, everything = self.postings(data, offsets), np.arange(len(column))
        texts = column.to_pylist()
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for n, (rule, compiled, query) in enumerate(self.rules):
            for row in self.rows(query, postings, everything).tolist():
                out[row] += [(m.start(), n, m.end()) for m in compiled.finditer(texts[row] or "") if rule.passes(m)]
        for spans in out:
            spans.sort()
        return out


def spans_text(spans: list[tuple[int, int, int]], names: list[str]) -> str:
    return ",".join(f"{names[n]}:{a}:{b}" for a, n, b in spans)


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """doc_id, a count per base kind, the digest of the base spans and all spans of every row, in one pass without a shuffle."""
    rules, names, n_base = base + more, [r.kind for r in base + more], len(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scanner = Scanner(rules)
        for batch in batches:
            for piece in slices(batch):
                found = scanner.scan(piece.column("text"))
                own = [[s for s in spans if s[1] < n_base] for spans in found]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *(pa.array([sum(s[1] == k for s in spans) for spans in own], pa.int64()) for k in range(n_base)),
                     pa.array([hashlib.sha256(spans_text(s, names).encode()).hexdigest() for s in own]), pa.array([spans_text(s, names) for s in found])],
                    names=["doc_id", *(f"n_{k}" for k in names[:n_base]), "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} long" for k in names[:n_base])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string")
