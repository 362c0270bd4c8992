"""Small-area estimation: pull noisy values toward what is typical nearby, by as much as their own
uncertainty says; regressions, parity and segregation indices; resampled variances.

Centers are exact medians from counted values, never a collected group. Every group summary joins back
on its key; the planner broadcasts it when it is measured to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import MARGIN_Z, MAX_CV, safe_divide
from ..session import DEFAULT_LIMITS, Limits
from . import rank
from .resample import resampled_sums

# Fixed values of the estimators.
MIN_CENTER_ROWS = 3
LOG_TAU2_FLOOR = 0.02
UNKNOWN_SE = 0.5
RATIO_TAU2_FLOOR = 0.0004
RATIO_CLIP = (0.9, 2.0)
MIN_RECENT = 10
ELASTICITY_GATES = {"b": (0.5, 2.0), "g": (0.05, 0.6)}
MIN_FIT_GROUPS = 5
MIN_GROUP_SHARE, MIN_GROUP_HOUSEHOLDS = 0.05, 100
MIN_UNITS, MIN_DIVERSITY = 4, 15.0
PRICE_RATIO_RANGE = (0.5, 3.0)


# --- means and fits --------------------------------------------------------


def geometric_mean(df: DataFrame, by: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Weighted geometric mean of the positive values; an unknown or small weight counts one."""
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(1.0))
    kept = df.filter(F.col(value) > 0)
    return kept.groupBy(*by).agg(F.exp(F.sum(w * F.ln(value)) / F.sum(w)).alias(out))


def elasticity(df: DataFrame, y: str, x: str, out: str) -> DataFrame:
    """Slope of log y on log x over the rows where both are positive, and how many there are."""
    kept = df.filter((F.col(y) > 0) & (F.col(x) > 0))
    return kept.agg(F.regr_slope(F.ln(y), F.ln(x)).alias(out), F.count("*").alias(f"{out}_n"))


def localize(df: DataFrame, key: str, level: str, group: str, state: str, own: str, weight: str, part: str, whole: str,
             group_level: str = "metro") -> DataFrame:
    """Localize a published two-level index: part × (own / parent's own)^b, whole × (part ratio)^g.

    A row's parent is its group (at ``group_level``) or its state; a state's reference covers all of its
    rows. Both exponents are fitted over the groups' published values; an implausible or thin fit leaves
    everything as published, and so does a row without its own figure. Parent values are kept as
    ``<part>_parent`` and ``<whole>_parent``, so running it again changes nothing.
    """
    for c in (part, whole):
        if f"{c}_parent" not in df.columns:
            df = df.withColumn(f"{c}_parent", F.col(c))
    in_group = F.col(level) == group_level
    group_ref = geometric_mean(df.filter(in_group), [group], own, weight, "_group_ref")
    state_ref = geometric_mean(df, [state], own, weight, "_state_ref")
    known = df.filter(in_group & F.col(f"{whole}_parent").isNotNull())
    parents = known.groupBy(group).agg(F.max(f"{part}_parent").alias("_p"), F.max(f"{whole}_parent").alias("_w")).join(
        group_ref, group).filter(F.col("_p").isNotNull() & F.col("_w").isNotNull() & F.col("_group_ref").isNotNull())
    fit = parents.agg(
        F.regr_slope(F.ln("_p"), F.ln("_group_ref")).alias("_b"), F.regr_slope(F.ln("_w"), F.ln("_p")).alias("_g"),
        F.count("*").alias("_groups"))
    (b0, b1), (g0, g1) = ELASTICITY_GATES["b"], ELASTICITY_GATES["g"]
    usable = ((F.col("_groups") >= MIN_FIT_GROUPS) & (F.col("_b") > b0) & (F.col("_b") < b1)
              & (F.col("_g") > g0) & (F.col("_g") < g1))
    rows = df.join(group_ref, group, "left").join(state_ref, state, "left")
    rows = rows.join(F.broadcast(fit), F.lit(True), "left")  # one row
    ref = F.when(in_group, F.col("_group_ref")).otherwise(F.col("_state_ref"))
    ratio = F.when(F.col(own) > 0, F.col(own) / ref)
    local_part = F.coalesce(F.col(f"{part}_parent") * F.pow(ratio, F.col("_b")), F.col(f"{part}_parent"))
    rows = rows.withColumn(part, F.when(usable, local_part).otherwise(F.col(f"{part}_parent")))
    local_whole = F.coalesce(F.col(f"{whole}_parent") * F.pow(F.col(part) / F.col(f"{part}_parent"), F.col("_g")),
                             F.col(f"{whole}_parent"))
    rows = rows.withColumn(whole, F.when(usable, local_whole).otherwise(F.col(f"{whole}_parent")))
    return rows.drop("_group_ref", "_state_ref", "_b", "_g", "_groups")


# --- parity and segregation ------------------------------------------------


def income_parity(groups: DataFrame, key: str, median: str = "median", households: str = "households", moe: str = "moe",
                  total: str = "total", out: str = "income_parity") -> DataFrame:
    """Lowest group median as a share of the highest, over groups big and certain enough; unknown with
    fewer than two."""
    sure = F.col(moe).isNotNull() & (F.col(moe) / MARGIN_Z / F.col(median) <= MAX_CV)
    counts = (F.col(median) > 0) & (F.col(households) >= MIN_GROUP_HOUSEHOLDS) & (F.col(total) > 0) & (
        F.col(households) / F.col(total) >= MIN_GROUP_SHARE) & sure
    usable = F.when(F.coalesce(counts, F.lit(False)), F.col(median))
    return groups.groupBy(key).agg(F.when(F.count(usable) >= 2, 100 * F.min(usable) / F.max(usable)).alias(out))


def _entropy_term(p: Column) -> Column:
    return F.when(p > 0, -p * F.ln(p)).otherwise(0.0)


def integration(counts: DataFrame, key: str, unit: str, group: str, people: str, out: str = "integration") -> DataFrame:
    """100 × (1 − Theil's H) over a place's units and groups; unknown with too few populated units or
    nearly one group. Two levels of aggregation, no collected units."""
    cells = counts.groupBy(key, unit, group).agg(F.sum(people).alias("_c"))
    units = cells.groupBy(key, unit).agg(F.sum("_c").alias("_t")).filter(F.col("_t") > 0)
    shares = cells.join(units, [key, unit]).withColumn("_e", _entropy_term(F.col("_c") / F.col("_t")))
    unit_entropy = shares.groupBy(key, unit).agg(F.max("_t").alias("_t"), F.sum("_e").alias("_et"))
    by_unit = unit_entropy.groupBy(key).agg(F.count("*").alias("_units"), F.sum("_t").alias("_total"),
                                            F.sum(F.col("_t") * F.col("_et")).alias("_wet"))
    groups = shares.groupBy(key, group).agg(F.sum("_c").alias("_g"))
    totals = groups.groupBy(key).agg(F.sum("_g").alias("_all"))
    p = F.col("_g") / F.col("_all")
    whole = groups.join(totals, key).groupBy(key).agg(F.sum(_entropy_term(p)).alias("_e"),
                                                      (100 * (1 - F.sum(p * p))).alias("_diversity"))
    h = (F.col("_e") - F.col("_wet") / F.col("_total")) / F.col("_e")
    ok = (F.col("_units") >= MIN_UNITS) & (F.col("_diversity") >= MIN_DIVERSITY)
    return by_unit.join(whole, key).select(key, F.when(ok, 100 * (1 - h)).alias(out))


# --- log ratios with resampled variance ------------------------------------


def _rate_sums(w: Column, tax: str, value: str, recent: str) -> list[Column]:
    new = F.col(recent)
    return [F.sum(w * F.col(tax)).alias("_at"), F.sum(w * F.col(value)).alias("_av"),
            F.sum(F.when(new, w * F.col(tax))).alias("_nt"), F.sum(F.when(new, w * F.col(value))).alias("_nv")]


def _log_ratio() -> Column:
    rate, new = safe_divide("_at", "_av"), safe_divide("_nt", "_nv")
    return F.when((rate > 0) & (new > 0), F.ln(new / rate))


def log_rate_ratio(df: DataFrame, by: Sequence[str], tax: str, value: str, weight: str, recent: str, out: str) -> DataFrame:
    """Log of the recent rows' aggregate rate over all rows', weighted; and the recent sample size."""
    sums = df.groupBy(*by).agg(*_rate_sums(F.col(weight), tax, value, recent),
                               F.count_if(F.col(recent)).alias("n_recent"))
    return sums.select(*by, _log_ratio().alias(out), "n_recent")


def bootstrap_variance(df: DataFrame, by: Sequence[str], keys: Sequence[str], tax: str, value: str, weight: str, recent: str,
                       out: str, replicates: int = 200, seed: Column | None = None, stream: int = 0) -> DataFrame:
    """Sampling variance of the log ratio over Poisson resamples of the records.

    ``seed``: the number a record draws by, else a hash of its ``keys``; another ``stream`` gives other, independent draws.
    """
    w, new = F.col(weight), F.col(recent)
    sums = resampled_sums(df, by, F.xxhash64(*[F.col(k) for k in keys]) if seed is None else seed, {
        "_at": w * F.col(tax), "_av": w * F.col(value), "_nt": F.when(new, w * F.col(tax)), "_nv": F.when(new, w * F.col(value))}, replicates, stream)
    rate = lambda t, v: F.when(v > 0, t / v)
    ratios = F.transform(F.arrays_zip("_at", "_av", "_nt", "_nv"), lambda x: F.struct(rate(x["_at"], x["_av"]).alias("rate"), rate(x["_nt"], x["_nv"]).alias("new")))
    known = F.filter(ratios, lambda x: (x["rate"] > 0) & (x["new"] > 0))
    logs = sums.select(*by, F.transform(known, lambda x: F.ln(x["new"] / x["rate"])).alias("_l"))
    mean = F.aggregate("_l", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_l"), F.lit(0))
    logs = logs.withColumn("_mean", mean)
    squares = F.aggregate("_l", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
    return logs.select(*by, (squares / F.nullif(F.size("_l"), F.lit(0))).alias(out))


def shrink_log_ratios(groups: DataFrame, group: str, state: str, states: DataFrame) -> DataFrame:
    """Pull each group's log ratio ``l`` (variance ``se2``) toward its state's ``state_l``.

    A group with too few recent rows takes its state's.
    """
    ok = F.col("l").isNotNull() & (F.col("n_recent") >= MIN_RECENT)
    rows = groups.join(states, state).withColumn("l", F.when(ok, F.col("l")))
    tau = rows.groupBy(state).agg(
        F.greatest(F.lit(RATIO_TAU2_FLOOR), F.coalesce(F.avg(F.pow(F.col("l") - F.col("state_l"), 2))
                   - F.avg(F.when(F.col("l").isNotNull(), F.col("se2"))), F.lit(RATIO_TAU2_FLOOR))).alias("_tau2"))
    b = F.col("se2") / (F.col("se2") + F.col("_tau2"))
    hat = F.when(F.col("l").isNotNull(), (1 - b) * F.col("l") + b * F.col("state_l")).otherwise(F.col("state_l"))
    return rows.join(tau, state).withColumn("l_hat", hat).drop("_tau2")


def county_ratios(groups: DataFrame, crosswalk: DataFrame, counties: DataFrame, county: str, group: str, state: str, states: DataFrame) -> DataFrame:
    """Ratio and recent sample per county: the mean of ``l_hat`` over the crosswalk's rows, each with its group's, as a clipped ratio;
    each group's ``n_recent`` once. Counties outside the crosswalk take their state's ``state_l``, without a sample.

    A county of the crosswalk none of whose groups has an estimate, and one whose state has none, get no row.
    """
    lo, hi = RATIO_CLIP
    clipped = lambda l: F.round(F.greatest(F.lit(lo), F.least(F.lit(hi), F.exp(l))), 3)
    cells = crosswalk.groupBy(county, state, group).agg(F.count("*").alias("_rows")).join(groups.select(state, group, "l_hat", "n_recent"), [state, group], "left")
    known = cells.groupBy(county).agg((F.sum(F.col("_rows") * F.col("l_hat")) / F.sum(F.when(F.col("l_hat").isNotNull(), F.col("_rows")))).alias("_l"),
                                      F.sum("n_recent").alias("sample"))
    inside = known.filter(F.col("_l").isNotNull()).select(county, clipped(F.col("_l")).alias("ratio"), "sample")
    outside = counties.join(known.select(county), county, "left_anti").join(states.filter(F.col("state_l").isNotNull()), state).select(
        county, clipped(F.col("state_l")).alias("ratio"), F.lit(None).cast("long").alias("sample"))
    return inside.unionByName(outside)


# --- medians and rates shrunk toward their neighbours ------------------------


def shrink_log_medians(df: DataFrame, est: str, moe: str, group: str, state: str, residential: str, keep: str, out: str,
                       parent: str | None = None, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Estimates of log medians (same units as ``est``): each pulled toward its group's median (three
    rows or more), else its parent's, else its state's. Rows marked ``keep`` stay as published."""
    y = F.when((F.col(est) > 0) & ~F.coalesce(F.col(keep), F.lit(False)), F.ln(F.col(est)))
    se = F.when(F.col(moe) >= 0, F.col(moe) / MARGIN_Z / F.col(est)).otherwise(F.lit(UNKNOWN_SE))
    rows = df.withColumns({"_y": y, "_se2": F.when(y.isNotNull(), se * se)})
    usable = F.col("_y").isNotNull() & F.coalesce(F.col(residential), F.lit(False))
    rows = rows.withColumn("_u", F.when(usable, F.col("_y")))
    pool = rows.filter(F.col("_u").isNotNull())
    center = None
    for level, least, name in ((group, MIN_CENTER_ROWS, "_m0"), (parent, MIN_CENTER_ROWS, "_m1"), (state, 1, "_m2")):
        if level is None:
            continue
        mids = rank.median(pool, [level], "_u", name, limits).filter(F.col("n") >= least).drop("n")
        rows = rows.join(mids, level, "left")
        center = F.col(name) if center is None else F.coalesce(center, F.col(name))
    rows = rows.withColumn("_mu", center)
    tau = rows.filter(F.col("_u").isNotNull()).groupBy(state).agg(F.greatest(
        F.lit(LOG_TAU2_FLOOR), F.avg(F.pow(F.col("_u") - F.col("_mu"), 2)) - F.avg("_se2")).alias("_tau2"))
    rows = rows.join(tau, state, "left")
    b = F.col("_se2") / (F.col("_se2") + F.col("_tau2"))
    shrunk = F.exp(F.col("_y") + b * (F.col("_mu") - F.col("_y")))
    return rows.withColumn(out, F.coalesce(shrunk, F.col(est))).drop(
        "_y", "_se2", "_u", "_m0", "_m1", "_m2", "_mu", "_tau2")


def shrink_rates(df: DataFrame, rate: str, population: str, months: str, agency: str, state: str, out: str) -> DataFrame:
    """Poisson–gamma estimates of rates per 100,000: one prior per state over its distinct agencies
    (three or more)."""
    exposure = F.when((F.col(population) > 0) & (F.col(months) > 0) & F.col(rate).isNotNull(),
                      F.col(population) * F.col(months) / 12 / 100_000)
    rows = df.withColumn("_e", exposure)
    agencies = rows.filter(F.col("_e").isNotNull() & F.col(agency).isNotNull()).groupBy(state, agency).agg(
        F.max("_e").alias("_e"), F.max(F.col(rate) * F.col("_e")).alias("_c"))
    moments = agencies.groupBy(state).agg(
        F.count("*").alias("_n"), F.sum("_e").alias("_se"), F.sum("_c").alias("_sc"),
        F.sum(F.col("_c") * F.col("_c") / F.col("_e")).alias("_scc"), F.avg("_e").alias("_me"))
    m = F.col("_sc") / F.col("_se")
    v = F.greatest(F.col("_scc") / F.col("_se") - m * m - m / F.col("_me"), F.pow(0.1 * m, 2))
    prior = moments.filter((F.col("_n") >= 3) & (F.col("_sc") > 0)).select(state, (m * m / v).alias("_alpha"), (m / v).alias("_beta"))
    rows = rows.join(prior, state, "left")
    est = (F.col(rate) * F.col("_e") + F.col("_alpha")) / (F.col("_e") + F.col("_beta"))
    return rows.withColumn(out, F.coalesce(est, F.col(rate).cast("double"))).drop("_e", "_alpha", "_beta")


def scaled_estimate(shown: str, eb: str, census: str, keep: str) -> Column:
    """The shown value × (estimate ÷ published), where the shown value rests on the published one."""
    usable = (F.col(census) != 0) & ~F.coalesce(F.col(keep), F.lit(False)) & (F.col(eb) != 0)
    return F.when(F.coalesce(usable, F.lit(False)), F.col(shown) * F.col(eb) / F.col(census)).otherwise(F.col(shown))


# --- today's prices ----------------------------------------------------------


def price_ratios(df: DataFrame, zip_code: str, census: str, market: str, county: str, usable: str,
                 limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Per (county, ZIP): median market value ÷ median usable census value, kept inside the range."""
    rows = df.filter(F.col(zip_code).isNotNull())
    pub = rank.median(rows.filter(F.col(usable)), [county, zip_code], census, "_c", limits).drop("n")
    now = rank.median(rows, [county, zip_code], market, "_w", limits).drop("n")
    ratio = F.col("_w") / F.col("_c")
    lo, hi = PRICE_RATIO_RANGE
    return pub.join(now, [county, zip_code]).filter(
        (F.col("_c") != 0) & (F.col("_w") != 0) & (ratio >= lo) & (ratio <= hi)).select(
            county, zip_code, ratio.alias("ratio"))


def today_prices(df: DataFrame, zip_code: str, census: str, market: str, county: str, topcoded: str, not_a_price: str,
                 out: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Published values at today's prices: × the ZIP's ratio, else the county's median ratio, else the
    national one. No published value, a top-code floor with a market value, or one that is not a house
    price takes the market value."""
    usable = F.col(census).isNotNull() & ~F.col(topcoded) & ~F.col(not_a_price)
    rows = df.withColumn("_usable", usable)
    ratios = price_ratios(rows, zip_code, census, market, county, "_usable", limits)
    by_county = rank.median(ratios, [county], "ratio", "_county_ratio", limits).drop("n")
    national = rank.median(ratios, [], "ratio", "_national_ratio", limits).drop("n")
    rows = rows.join(ratios.withColumnRenamed("ratio", "_zip_ratio"), [county, zip_code], "left").join(by_county, county, "left")
    rows = rows.join(F.broadcast(national), F.lit(True), "left")  # one row
    ratio = F.coalesce("_zip_ratio", "_county_ratio", "_national_ratio", F.lit(1.0))
    scaled = F.col(census).isNotNull() & ~F.col(not_a_price) & ~(F.col(topcoded) & F.col(market).isNotNull())
    return rows.withColumn(out, F.when(scaled, F.col(census) * ratio).otherwise(F.col(market))).drop(
        "_usable", "_zip_ratio", "_county_ratio", "_national_ratio")


def today_values(df: DataFrame, state: str, census: str, market: str, out: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Typical value today and where it came from: the market's, else published × the state's median
    ratio, else × the national one."""
    ratio = F.when((F.col(market) > 0) & (F.col(census) > 0), F.col(market) / F.col(census))
    rows = df.withColumn("_ratio", ratio)
    by_state = rank.median(rows, [state], "_ratio", "_state_ratio", limits).drop("n")
    national = rank.median(rows, [], "_ratio", "_national", limits).drop("n")
    rows = rows.join(by_state, state, "left").join(F.broadcast(national), F.lit(True), "left")  # one row
    scale = F.coalesce("_state_ratio", "_national", F.lit(1.0))
    source = (F.when(F.col(market) > 0, "market").when(F.col(census).isNotNull() & F.col("_state_ratio").isNotNull(), "state_ratio")
              .when(F.col(census).isNotNull(), "national_ratio"))
    return rows.withColumns({out: F.when(F.col(market) > 0, F.col(market)).otherwise(F.col(census) * scale),
                             f"{out}_source": source}).drop("_ratio", "_state_ratio", "_national")
