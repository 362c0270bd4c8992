"""Flag sets per row: arrays of short names, stored as ``;``-separated text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import MAX_CV, MAX_SHARE_MARGIN, col, variation

# Which measures a flag covers when it is not the measure's own name, which flags
# matter in a list, and which never earn a caution there.
FLAG_COVERS = {
    "mobile_homes": ["median_home_value"],
    "property_tax_rate": ["property_tax_rate", "taxes", "taxes_rate"],
}
HEADLINE_FLAGS = ["median_home_value", "per_capita_income", "median_household_income", "median_gross_rent",
                  "sale_price", "crime", "mobile_homes"]


def read_flags(c: Column | str) -> Column:
    """``"a;b"`` to an array; NULL and empty text to an empty array."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), ";"), lambda f: f != "")


def write_flags(c: Column | str) -> Column:
    return F.array_join(col(c), ";")


def flag_set(rules: Mapping[str, Column]) -> Column:
    """The names whose condition holds, in rule order (an unknown condition does not hold)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
                                     for name, cond in rules.items()]))


def estimate_flag(est: Column | str, moe: Column | str, topcoded: Column | None = None,
                  max_cv: float = MAX_CV) -> Column:
    """Unreliable: a wide margin, or no margin at all unless the value is a top-code floor."""
    est, moe = col(est), col(moe)
    topped = F.coalesce(topcoded, F.lit(False)) if topcoded is not None else F.lit(False)
    no_margin = est.isNotNull() & moe.isNull() & ~topped
    return F.coalesce(variation(est, moe) > max_cv, F.lit(False)) | no_margin


def share_flag(margin: Column | str, limit: float = MAX_SHARE_MARGIN) -> Column:
    return F.coalesce(col(margin) > limit, F.lit(False))


def topcodes(caps: Mapping[str, float]) -> Column:
    """Names of the columns at or above their top code."""
    return flag_set({name: F.col(name) >= F.lit(cap) for name, cap in caps.items()})


def covered_columns(flags: Column | str, covers: Mapping[str, Sequence[str]] = FLAG_COVERS) -> Column:
    """The measures a row's flags cover."""
    def expand(f: Column) -> Column:
        out = F.array(f)
        for name, columns in covers.items():
            out = F.when(f == name, F.array(*[F.lit(c) for c in columns])).otherwise(out)
        return out
    return F.array_distinct(F.flatten(F.transform(col(flags), expand)))


def caution_flags(flags: Column | str, shows_own_rate: Column) -> Column:
    """Flags that earn a caution: never ``crime_wide``; ``crime`` only with a figure of its own."""
    own = F.coalesce(shows_own_rate, F.lit(False))
    return F.filter(col(flags), lambda f: (f != "crime_wide") & ((f != "crime") | own))


def headline_flags(flags: Column | str, headline: Sequence[str] = HEADLINE_FLAGS) -> Column:
    return F.array_intersect(col(flags), F.array(*[F.lit(f) for f in headline]))


def replace_flags(flags: Column | str, clear: Sequence[str], add: Mapping[str, Column]) -> Column:
    """Drop the named flags, then add those whose rule holds now (safe to run again)."""
    kept = F.array_except(col(flags), F.array(*[F.lit(f) for f in clear])) if clear else col(flags)
    return F.array_union(kept, flag_set(add))
