"""Unknowns, sentinels, safe arithmetic, rounding and margins of error.

Unknown is NULL everywhere: never 0, never imputed, never NaN (Spark sorts NaN above every
number, so a stray NaN would rank best).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (published by the data sources).
SENTINEL_CEILING = -666_666          # estimates at or below this are "no value" markers
CONTROLLED_MARGIN = -555_555_555     # "controlled, no sampling error": a margin of zero
MARGIN_Z = 1.645                     # 90 % margin of error over standard error
MAX_CV = 0.40                        # coefficient of variation above which a value is unreliable
MAX_SHARE_MARGIN = 15.0              # percentage points


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """NaN and infinities become NULL; apply where floating-point data enters."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def number(c: Column | str) -> Column:
    """A dirty string as a double, NULL where it is not a finite number."""
    return known(F.expr("try_cast(null as double)") if c is None else col(c).try_cast("double"))


def sentinel_to_null(c: Column | str, ceiling: float = SENTINEL_CEILING) -> Column:
    c = col(c)
    return F.when(c > F.lit(ceiling), c)


def codes_to_null(c: Column | str, codes: Iterable[float]) -> Column:
    c = col(c)
    return F.when(~c.isin(*codes), c)


def margin_of_error(c: Column | str) -> Column:
    """A published margin: the "controlled" code is 0, any other negative code is unknown."""
    c = col(c)
    return F.when(c == F.lit(CONTROLLED_MARGIN), F.lit(0.0)).when(c >= 0, c.cast("double"))


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    """NULL where the denominator is NULL, zero or negative."""
    n, d = col(numerator).cast("double"), col(denominator).cast("double")
    return F.when(d > 0, n / d)


def known_sum(cols: Sequence[Column | str]) -> Column:
    """Sum of the known parts; NULL only when every part is unknown."""
    parts = [col(c) for c in cols]
    total = sum((F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts[1:]),
                F.coalesce(parts[0].cast("double"), F.lit(0.0)))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clamp, keeping NULL (``least`` and ``greatest`` skip NULLs, so guard)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c.cast("double"))))


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Round halves to the even neighbour."""
    return F.bround(col(c), digits)


def half_up_floor(c: Column | str) -> Column:
    """Round halves toward plus infinity."""
    return F.floor(col(c) + 0.5)


def equality_rounded(a: Column | str, b: Column | str, digits: int = 3) -> Column:
    """Null-safe equality after rounding."""
    return F.round(col(a), digits).eqNullSafe(F.round(col(b), digits))


# --- margins ---------------------------------------------------------------


def sum_margin(margins: Sequence[Column | str]) -> Column:
    """Margin of a sum: quadrature of the known parts, NULL when none is known."""
    return F.sqrt(known_sum([F.pow(col(m), 2) for m in margins]))


def share_margin(num: Column | str, num_moe: Column | str, den: Column | str, den_moe: Column | str) -> Column:
    """Margin of a proportion; the ratio form where the proportion's radicand is negative."""
    n, nm, d, dm = col(num), col(num_moe), col(den), col(den_moe)
    p = n / d
    minus = nm * nm - p * p * dm * dm
    plus = nm * nm + p * p * dm * dm
    return F.when(d > 0, F.sqrt(F.when(minus >= 0, minus).otherwise(plus)) / d)


def ratio_margin(num: Column | str, num_moe: Column | str, den: Column | str, den_moe: Column | str) -> Column:
    n, nm, d, dm = col(num), col(num_moe), col(den), col(den_moe)
    r = n / d
    return F.when(d > 0, F.sqrt(nm * nm + r * r * dm * dm) / d)


def variation(est: Column | str, moe: Column | str) -> Column:
    """Coefficient of variation of an estimate from its margin."""
    return safe_divide(col(moe) / F.lit(MARGIN_Z), est)
