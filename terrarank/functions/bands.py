"""Values to words: rows of cuts with a template each, filled from columns. The rows are the caller's."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col, half_up_floor

# (operator, limit, template) in ascending order, and the template past the last cut; a template None says nothing.
Cuts = tuple[Sequence[tuple[str, float, str | None]], str | None]


def filled(template: str | None, parts: Mapping[str, Column] | None = None) -> Column:
    """A template with each ``{name}`` replaced by that part; NULL where a part is."""
    if template is None:
        return F.lit(None).cast("string")
    pieces = re.split(r"\{(\w+)\}", template)
    texts = [(parts or {})[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p]
    return F.concat(*texts) if len(texts) > 1 else texts[0] if texts else F.lit("")


def band(value: Column | str, words: Cuts, unknown: Column | str | None = None, parts: Mapping[str, Column] | None = None) -> Column:
    """The template of the first cut the value is under; ``unknown`` for NULL."""
    v = col(value)
    cuts, last = words
    out = F.when(v.isNull(), unknown if isinstance(unknown, Column) else filled(unknown, parts))
    for op, limit, word in cuts:
        out = out.when(v < limit if op == "<" else v <= limit, filled(word, parts))
    return out.otherwise(filled(last, parts))


def joined(bits: Sequence[Column], separator: str, empty: str) -> Column:
    """The bits that are known, as one text that begins with a capital."""
    text = F.concat_ws(separator, *bits)
    return F.when(text == "", empty).otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000)))


def foremost(values: Sequence[tuple[str, Column | str]]) -> Column:
    """``value`` and ``label`` of the largest of labelled columns, the first of equal ones."""
    known = [F.struct(col(c).alias("value"), F.lit(-i).alias("order"), F.lit(label).alias("label")) for i, (label, c) in enumerate(values)]
    return F.array_max(F.array(*known))


def whole(value: Column | str) -> Column:
    """A number as text, halves rounded up."""
    return half_up_floor(value).cast("long").cast("string")


def fixed1(value: Column | str) -> Column:
    return F.replace(F.format_number(col(value), 1), F.lit(","), F.lit(""))


def ordinal(value: Column | str, endings: Mapping[int, str], other: str) -> Column:
    """A whole number with its ending, by the last digit but for 11 to 13."""
    n = half_up_floor(value).cast("long")
    found = F.element_at(F.create_map(*[x for d, e in endings.items() for x in (F.lit(d), F.lit(e))]), (n % 10).cast("int"))
    return F.concat(n.cast("string"), F.when((n % 100).between(11, 13), other).otherwise(F.coalesce(found, F.lit(other))))


def metro_city(metro: Column | str, hyphenated: Sequence[str]) -> Column:
    """A metro's first city."""
    names = "|".join(map(re.escape, hyphenated))
    return F.trim(F.regexp_extract(F.trim(F.substring_index(col(metro), ",", 1)), rf"^({names}|[^-]*)", 1))


def standing_case(direction: Column | str, points: Column | str, beats: Column | str, top: tuple[float, float], tie: float) -> Column:
    """Where a value stands: ``unranked``, ``top`` (full points, though others have them too), ``tied`` or ``over`` others."""
    p, b = col(points), col(beats)
    return (F.when(F.coalesce(p, b).isNull() | (p + b).isNull() | (col(direction) == "middle"), "unranked")
            .otherwise(F.when((p >= top[0]) & (b < top[1]), "top").otherwise(F.when(p - b < tie, "over").otherwise("tied"))))


def by_case(case: Column, templates: Mapping[str, str], parts: Mapping[str, Column]) -> Column:
    """The template of a case, filled."""
    return F.coalesce(*[F.when(case == name, filled(t, parts)) for name, t in templates.items()])
