"""Values to points, 0–100 with higher better."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import clip, col

# Fixed values of the scoring model.
MAX_WEIGHT = 5.0
AVERAGE_POINTS = 50.0            # what a weighted measure without a value counts as
BUDGET_STRETCH = 1.5             # a typical price at this multiple of the budget earns nothing
PM25_BANDS = [5.0, 7.0, 9.0, 12.0]
PM25_BAND_POINTS = [100.0, 75.0, 50.0, 25.0, 0.0]
PM25_SIGMA = 1.7
PM25_DOUBT_CAP = 50.0
SMOKE_BEST, SMOKE_WORST = 5.0, 30.0
OLD_HOMES_BEST, OLD_HOMES_WORST = 0.0, 60.0
ERF_P = 0.3275911                # Abramowitz and Stegun 7.1.26
ERF_COEFFICIENTS = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def clamp_weight(w: Column | str) -> Column:
    """0–5; unknown and non-finite weights count nothing."""
    w = col(w).cast("double")
    finite = w.isNotNull() & ~F.isnan(w) & (F.abs(w) != F.lit(float("inf")))
    return F.when(finite, F.least(F.lit(MAX_WEIGHT), F.greatest(F.lit(0.0), w))).otherwise(0.0)


def directional(lo: Column | str, hi: Column | str, mid: Column | str, direction: Column | str) -> Column:
    """Points of a value: it scores as at least as good as every value it ties with."""
    d = col(direction)
    return (F.when(d == "higher", col(hi)).when(d == "lower", 100 - col(lo))
            .when(d == "middle", 100 - 2 * F.abs(col(mid) - 50)))


def beats(lo: Column | str, hi: Column | str, direction: Column | str) -> Column:
    """Share of places strictly worse; NULL for ``middle``."""
    d = col(direction)
    return F.when(d == "higher", col(lo)).when(d == "lower", 100 - col(hi))


def budget_points(value: Column | str, budget: Column | str) -> Column:
    """100 at or under the budget, falling evenly to 0 at the stretch."""
    v, b = col(value), col(budget)
    slope = 100 * (BUDGET_STRETCH * b - v) / ((BUDGET_STRETCH - 1) * b)
    return F.when((b > 0) & v.isNotNull(), F.when(v <= b, 100.0).otherwise(F.greatest(F.lit(0.0), slope)))


def normal_cdf(z: Column | str) -> Column:
    z = col(z)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    # Bound once: the polynomial reads t five times.
    erf = F.transform(F.array(F.struct(x.alias("x"), (1 / (1 + F.lit(ERF_P) * x)).alias("t"))), _erf)[0]
    return 0.5 * (1 + F.signum(z) * erf)


def _erf(v: Column) -> Column:
    x, t = v["x"], v["t"]
    poly = F.lit(ERF_COEFFICIENTS[-1])
    for c in reversed(ERF_COEFFICIENTS[:-1]):
        poly = poly * t + F.lit(c)
    return 1 - poly * t * F.exp(-x * x)


def banded_points(value: Column | str, edges: list[float], points: list[float], sigma: float) -> Column:
    """Expected band points of a value known only to ± sigma."""
    v = col(value)
    # Summed by edge: each edge trades the band above it for the band below it.
    steps = F.array(*[F.struct(F.lit(e).alias("edge"), F.lit(lo - hi).alias("gain"))
                      for e, lo, hi in zip(edges, points, points[1:])])
    total = F.aggregate(steps, F.lit(points[-1]),
                        lambda acc, s: acc + s["gain"] * normal_cdf((s["edge"] - v) / F.lit(sigma)))
    return F.when(v.isNotNull(), total)


def pm25_points(value: Column | str, doubted: Column | None = None) -> Column:
    pts = banded_points(value, PM25_BANDS, PM25_BAND_POINTS, PM25_SIGMA)
    if doubted is None:
        return pts
    return F.when(F.coalesce(doubted, F.lit(False)), F.least(pts, F.lit(PM25_DOUBT_CAP))).otherwise(pts)


def linear_points(value: Column | str, best: float, worst: float) -> Column:
    return clip(100 * (F.lit(worst) - col(value)) / (worst - best), 0, 100)


# Measures scored on fixed anchors instead of ranks: (value, flagged) -> points. Add a measure by
# adding a builder.
ANCHORED: dict[str, Callable[[Column, Column], Column]] = {
    "pm25": lambda v, flagged: pm25_points(v, flagged),
    "smoke_days_thick": lambda v, _: linear_points(v, SMOKE_BEST, SMOKE_WORST),
    "pre1960_share": lambda v, _: linear_points(v, OLD_HOMES_BEST, OLD_HOMES_WORST),
}


def anchored_points(metric: Column | str, value: Column | str, flagged: Column | str,
                    builders: dict[str, Callable[[Column, Column], Column]] | None = None) -> Column:
    """Points of the anchored measures; NULL for the others."""
    out = F.lit(None).cast("double")
    for name, build in (builders or ANCHORED).items():
        out = F.when(col(metric) == name, build(col(value), col(flagged))).otherwise(out)
    return out


def is_anchored(metric: Column | str, builders: dict[str, Callable[[Column, Column], Column]] | None = None) -> Column:
    return col(metric).isin(*(builders or ANCHORED))
