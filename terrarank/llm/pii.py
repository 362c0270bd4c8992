"""Operator 9, personal data: regular expressions propose spans, checksums confirm them, words nearby move the score.

Base spans (email, ip, card, phone) follow their rules alone. International bank account numbers are added when they pass
mod 97, social-security-like numbers when a word nearby speaks for them. Every span has a score: its kind's start, more for a
passed checksum, more or less for words within ``NEAR`` characters.

All patterns run in linear time, so very long texts cost what their length costs. Spans are code points, end exclusive.
Edges: null text is empty text and has no spans; empty rows get the digest of an empty list; repeated rows get a row each;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import forget, slices

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")   # the first four are base spans
NEAR = 40
START = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.5, "ssn": 0.2}
CHECKED = {"card": 0.4, "iban": 0.4}
FOR = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "server", "host", "address"), "card": ("card", "credit", "visa", "payment", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile"), "iban": ("iban", "bank", "account", "konto", "cuenta"), "ssn": ("ssn", "social security"),
}
AGAINST = ("version", "order no", "isbn", "example")

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that doesn't lead to a match leads to none from its middle either: it is tried once, from its start
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
_IBAN, _SSN = re.compile(IBAN, re.ASCII), re.compile(SSN, re.ASCII)
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their signs."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def propose(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of spans that pass their checks, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            # more than 19 digits can't pass: no need to look at them all
            digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() <= 37 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        out += [(m.start(), 4, m.end()) for m in _IBAN.finditer(text) if 15 <= len(x := m[0].replace(" ", "")) <= 34 and mod97(x)]
        out += [(m.start(), 5, m.end()) for m in _SSN.finditer(text) if context(text, m.start(), m.end(), "ssn") > 0]
    out.sort()
    return out


def context(text: str, start: int, end: int, kind: str) -> float:
    near = (text[max(0, start - NEAR): start] + " " + text[end: end + NEAR]).lower()
    return 0.2 * any(w in near for w in FOR[kind]) - 0.2 * any(w in near for w in AGAINST)


def score(text: str, span: tuple[int, int, int]) -> float:
    kind = KINDS[span[1]]
    return round(min(1.0, max(0.0, START[kind] + CHECKED.get(kind, 0.0) + context(text, span[0], span[2], kind))), 2)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, a count per base kind, the digest of the base spans, all spans and their scores, in one pass without a shuffle."""
    base = KINDS[:4]

    def joined(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for piece in slices(batch):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                found = [propose(t) for t in texts]
                own = [[s for s in spans if s[1] < len(base)] for spans in found]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *(pa.array([sum(s[1] == k for s in spans) for spans in own], pa.int64()) for k in range(len(base))),
                     pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in own]), pa.array([joined(s) for s in found]),
                     pa.array([[score(t, s) for s in spans] for t, spans in zip(texts, found)], pa.list_(pa.float64()))],
                    names=["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans", "scores"])

    counts = ", ".join(f"n_{k} long" for k in base)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id long, {counts}, base_sha256 string, spans string, scores array<double>")
