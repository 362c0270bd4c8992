"""Köppen–Geiger types from twelve monthly temperatures and precipitation totals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The half-years (positions in the year), the border shift, and the families of types.
SUMMER = [4, 5, 6, 7, 8, 9]
WINTER = [10, 11, 12, 1, 2, 3]
BORDER_C = 0.5
FAMILIES = [
    ("humid-south", "Humid South", ["Cfa", "Cwa"]),
    ("four-seasons", "Four seasons", ["Dfa", "Dwa"]),
    ("northern-cold", "Northern cold", ["Dfb", "Dwb"]),
    ("dry-sunny", "Dry & sunny", ["BSk", "BSh"]),
    ("desert", "Desert", ["BWh", "BWk"]),
    ("west-coast", "West Coast", ["Csa", "Csb", "Csc"]),
    ("mountain-west", "Mountain West", ["Dsa", "Dsb"]),
    ("tropical", "Tropical", ["Af", "Am", "Aw"]),
    ("highlands-alaska", "Highlands & Alaska", ["Cfb", "Cfc", "Cwb", "Cwc", "Dfc", "Dfd", "Dsc", "Dsd", "Dwc", "Dwd", "ET", "EF"]),
]


def family_rows() -> list[tuple[str, str, int, str]]:
    """(code, family, position, name) for every type."""
    return [(code, key, i, name) for i, (key, name, codes) in enumerate(FAMILIES) for code in codes]


def _pick(a: Column, months: list[int]) -> Column:
    return F.array(*[F.element_at(a, m) for m in months])


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def year_summary(temps: Column, rain: Column) -> Column:
    """What the type depends on, as one struct (°C and mm)."""
    summer, winter = _pick(rain, SUMMER), _pick(rain, WINTER)
    return F.struct(
        (_total(temps) / 12).alias("mean"), F.array_max(temps).alias("hot"), F.array_min(temps).alias("cold"),
        F.size(F.filter(temps, lambda t: t > 10)).alias("warm_months"), _total(rain).alias("rain"),
        _total(summer).alias("summer"), _total(winter).alias("winter"), F.array_min(rain).alias("dry"),
        F.array_min(summer).alias("summer_dry"), F.array_max(summer).alias("summer_wet"),
        F.array_min(winter).alias("winter_dry"), F.array_max(winter).alias("winter_wet"))


def koppen(y: Column, shift: float = 0.0) -> Column:
    """The type of a year summary with every month ``shift`` °C warmer.

    A shift moves the mean, the hottest and the coldest month; the count of months above 10 °C must be
    given for the shifted year (see :func:`shifted`).
    """
    mean, hot, cold = y["mean"] + shift, y["hot"] + shift, y["cold"] + shift
    dry_line = F.when((y["rain"] > 0) & (y["winter"] >= 0.7 * y["rain"]), 2 * mean).when(
        (y["rain"] > 0) & (y["summer"] >= 0.7 * y["rain"]), 2 * mean + 28).otherwise(2 * mean + 14)
    arid = F.concat(F.when(y["rain"] < 5 * dry_line, "BW").otherwise("BS"), F.when(mean >= 18, "h").otherwise("k"))
    tropical = F.when(y["dry"] >= 60, "Af").when(y["dry"] >= 100 - y["rain"] / 25, "Am").otherwise("Aw")
    second = F.when((y["summer_dry"] < 40) & (y["summer_dry"] < y["winter_wet"] / 3), "s").when(
        y["winter_dry"] < y["summer_wet"] / 10, "w").otherwise("f")
    third = F.when(hot >= 22, "a").when(y["warm_months"] >= 4, "b").when((cold <= 0) & (cold < -38), "d").otherwise("c")
    return (F.when(hot < 10, F.when(hot > 0, "ET").otherwise("EF")).when(y["rain"] < 10 * dry_line, arid)
            .when(cold >= 18, tropical).otherwise(F.concat(F.when(cold > 0, "C").otherwise("D"), second, third)))


def shifted(temps: Column, rain: Column, shift: float) -> Column:
    """The type of the year with every month shifted."""
    return F.transform(F.array(year_summary(F.transform(temps, lambda t: t + shift), rain)), koppen)[0]


def koppen_with_border(temps: Column, rain: Column) -> tuple[Column, Column]:
    """The type, and the first other type a border shift (warmer, then colder) would give."""
    base = shifted(temps, rain, 0.0)
    up, down = shifted(temps, rain, BORDER_C), shifted(temps, rain, -BORDER_C)
    return base, F.when(up != base, up).when(down != base, down)
