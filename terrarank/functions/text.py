"""Identity keys, names, labels and page text."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col

# Abbreviations folded when place names are compared, suffixes dropped from county
# names, civil divisions, the character a wrongly decoded text shows, and label punctuation.
PLACE_ALIASES = {"saint": "st", "sainte": "ste", "mount": "mt", "fort": "ft"}
COUNTY_SUFFIX = r"(?i)\s+(County|Parish|Borough|Census Area|Municipality|City and Borough)$"
MOJIBAKE = "Ã"
LABEL_DOT = " · "


def _accent_table() -> tuple[str, str]:
    """Single accented Latin letters and their base letters, by Unicode decomposition."""
    src, dst = [], []
    for code in range(0x00C0, 0x0250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            src.append(chr(code))
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _BASE = _accent_table()


def fold_accents(c: Column | str) -> Column:
    """Accents removed, letters kept (precomposed letters and combining marks alike)."""
    return F.regexp_replace(F.translate(col(c), _ACCENTED, _BASE), r"\p{M}", "")


def digits_key(c: Column | str, width: int = 5) -> Column:
    """A fixed-width numeric identity key: trailing ``.0`` and decoration removed, cut, zero-padded."""
    s = F.trim(col(c).cast("string"))
    s = F.when(~F.lower(s).isin("", "nan", "none", "na"), s)
    d = F.regexp_replace(F.regexp_replace(s, r"\.0$", ""), r"[^0-9]", "")
    return F.when(d != "", F.lpad(F.substring(d, 1, width), width, "0"))


def composite_key(parts: list[tuple[Column | str, int]]) -> Column:
    """One key from parts of known widths; an unknown part contributes nothing."""
    joined = F.concat(*[F.coalesce(digits_key(c, w), F.lit("")) for c, w in parts])
    return digits_key(joined, sum(w for _, w in parts))


def normalize_place(c: Column | str, aliases: Mapping[str, str] = PLACE_ALIASES) -> Column:
    """Lower case, no accents or punctuation, common abbreviations folded."""
    s = F.lower(fold_accents(c))
    s = F.regexp_replace(s, "['’.]", "")
    s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    def fold(w: Column) -> Column:
        out = w
        for long, short in aliases.items():
            out = F.when(w == long, F.lit(short)).otherwise(out)
        return out
    return F.array_join(F.transform(F.split(s, " "), fold), " ")


def county_key(c: Column | str) -> Column:
    """County names compared without case, spaces, punctuation or the kind of county."""
    s = F.regexp_replace(F.trim(col(c)), COUNTY_SUFFIX, "")
    return F.regexp_replace(F.upper(fold_accents(s)), "[^A-Z]", "")


# Fixed value: civil-division words an agency or place name can end with.
CIVIL_SUFFIX = r"\b(charter township|township|city|town|borough|village|plantation)$"


def civil_name(c: Column | str) -> Column:
    """An agency or place name without case, punctuation or its civil-division word."""
    s = F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z ]", ""))
    return F.trim(F.regexp_replace(s, CIVIL_SUFFIX, ""))


def civil_kind(c: Column | str) -> Column:
    """The civil-division word a name ends with, NULL without one."""
    s = F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z ]", ""))
    kind = F.regexp_extract(s, CIVIL_SUFFIX, 1)
    return F.when(kind.contains("township"), F.lit("township")).when(kind != "", kind)


def agency_display(name: Column | str) -> Column:
    """A jurisdiction's name without the county, "Metropolitan" and department words around it."""
    n = F.regexp_replace(col(name), r",\s*[^,]+\s+County$", "")
    n = F.regexp_replace(
        F.trim(n), r"(?i)\s+(Police Department|Police Dept\.?|Department of Public Safety|Public Safety Department)$", "")
    n = F.regexp_replace(n, r"(?i)^(Metropolitan|Metro)\s+", "")
    return F.trim(F.regexp_replace(n, r"(?i)\s+(Metropolitan|Metro)$", ""))


def agency_jurisdiction(name: Column | str) -> Column:
    """struct(jurisdiction, kind) read off an agency name; NULL for special agencies."""
    a = F.trim(col(name))
    sheriff = F.regexp_extract(a, r"(?i)^(.*?) County Sheriff'?s Office$", 1)
    of = F.regexp_extract(a, r"(?i)^(?:City|Town|Village) of (.+)$", 1)
    police = F.regexp_extract(a, r"(?i)^(.*?) Police Department$", 1)
    make = lambda j, k: F.struct(j.alias("jurisdiction"), F.lit(k).alias("kind"))
    return (F.when(sheriff != "", make(sheriff, "County")).when(of != "", make(of, "City"))
            .when(police != "", make(police, "City")))


def is_county_agency(name: Column | str) -> Column:
    return col(name).rlike(r"County \((sheriff|county police)")


def clean_place(c: Column | str) -> Column:
    """Consolidated city-county names made readable."""
    c = col(c)
    n = F.regexp_replace(c, r"\s*\(balance\)$", "")
    n = F.regexp_replace(n, r"\s+(unified|consolidated|metropolitan|metro)\s+government$", "")
    n = F.regexp_replace(n, r"\s+(city|town|village)$", "")
    return F.when(c.contains("(balance)") | c.contains("government"), n).otherwise(c)


# --- labels ----------------------------------------------------------------


def compose_label(neighborhood: Column | str, place: Column | str, near_place: Column | str,
                  county: Column | str, zip_code: Column | str) -> Column:
    """"Neighborhood, Place · ZIP", "Near X" outside any place, "Unincorporated …" with none near."""
    where = F.coalesce(col(place), F.concat(F.lit("Near "), col(near_place)),
                       F.concat(F.lit("Unincorporated "), F.substring_index(col(county), ",", 1)))
    name = F.coalesce(F.concat_ws(", ", F.when(col(neighborhood).isNotNull(), col(neighborhood)), where), where)
    return F.concat_ws(LABEL_DOT, name, col(zip_code))


def parse_label(c: Column | str) -> Column:
    """struct(neighborhood, city, near, zip) of a composed label."""
    c = col(c)
    zip_code = F.nullif(F.regexp_extract(c, r"^.* · (\d{5})$", 1), F.lit(""))
    head = F.trim(F.regexp_replace(c, r" · \d{5}$", ""))
    has_city = head.contains(", ")
    last = F.substring_index(head, ", ", -1)
    hood = F.regexp_replace(head, r", (?:(?!, ).)*$", "")
    near = ~has_city & head.startswith("Near ")
    city = F.when(has_city, F.regexp_replace(last, "^Near ", "")).when(near, F.regexp_replace(head, "^Near ", "")).otherwise(head)
    return F.struct(
        F.when(has_city, hood).alias("neighborhood"),
        F.nullif(city, F.lit("")).alias("city"),
        near.alias("near"),
        zip_code.alias("zip"),
    )


# --- pages -----------------------------------------------------------------


def page_text(c: Column | str) -> Column:
    """A page's text with markup, typographic quotes and spacing evened out, lower case."""
    s = F.regexp_replace(col(c), r"(?is)<script.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style.*?</style>", " ")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    s = F.replace(F.replace(s, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    s = F.translate(s, "’‘“”–—", "''\"\"--")
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def page_hash(c: Column | str) -> Column:
    """Sixteen hex digits of the text's SHA-256: changes when the words change, not the markup."""
    return F.substring(F.sha2(page_text(c), 256), 1, 16)


def strip_markup(c: Column | str) -> Column:
    """Cell text: tags removed, the common entities decoded, spacing collapsed."""
    s = F.regexp_replace(col(c), r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def strip_bom(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "^﻿", "")


def is_mojibake(c: Column | str) -> Column:
    return F.coalesce(col(c).contains(MOJIBAKE), F.lit(False))


def parse_date(c: Column | str) -> Column:
    """The first of the accepted date layouts that reads."""
    c = F.trim(col(c))
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy")])
