"""Estimators over places: shrinkage, localization, parity, segregation, resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import estimate, rank, resample
from . import base
from .registry import query, r, rs, shared, with_

EST = """est AS (SELECT place, county, state, population, 100000 + balance * 20 AS value,
  CASE WHEN place % 9 <> 0 THEN (100000 + balance * 20) * (0.05::DOUBLE + (place % 10) / 20.0::DOUBLE) END AS moe,
  place % 19 = 0 AS keep, county * 10 + place % 6 AS city, (population >= 51 AND group_quarters_share < 50) AS residential FROM places)"""


@shared
def estimates(t):
    k, v = F.col("place"), 100000 + F.col("balance") * 20
    return base.places(t).select(
        k, "county", "state", "population", v.alias("value"),
        F.when(k % 9 != 0, v * (F.lit(0.05) + (k % 10) / 20.0)).alias("moe"), (k % 19 == 0).alias("keep"),
        (F.col("county") * 10 + k % 6).alias("city"),
        ((F.col("population") >= 51) & (F.col("group_quarters_share") < 50)).alias("residential"))


SHRINK = """ys AS (SELECT *, CASE WHEN value > 0 AND NOT keep THEN ln(value) END AS y,
    CASE WHEN value > 0 AND NOT keep THEN pow(CASE WHEN moe >= 0 THEN moe / 1.645 / value ELSE 0.5 END, 2) END AS se2 FROM est),
  us AS (SELECT * FROM ys WHERE y IS NOT NULL AND residential),
  m0 AS (SELECT city, median(y) AS m0 FROM us GROUP BY 1 HAVING count(*) >= 3),
  m1 AS (SELECT county, median(y) AS m1 FROM us GROUP BY 1 HAVING count(*) >= 3),
  m2 AS (SELECT state, median(y) AS m2 FROM us GROUP BY 1),
  mu AS (SELECT ys.*, coalesce(m0, m1, m2) AS mu FROM ys LEFT JOIN m0 USING (city) LEFT JOIN m1 USING (county) LEFT JOIN m2 USING (state)),
  tau AS (SELECT state, greatest(0.02, avg(pow(y - mu, 2)) - avg(se2)) AS tau2 FROM mu WHERE y IS NOT NULL AND residential GROUP BY 1)"""


@query("D17", with_(*base.PLACE_SQL, EST, SHRINK, select=f"""SELECT place,
  {rs('coalesce(exp(y + se2 / (se2 + tau2) * (mu - y)), value)', 4)} AS value_eb FROM mu LEFT JOIN tau USING (state)"""))
def shrunk_medians(t):
    out = estimate.shrink_log_medians(estimates(t), "value", "moe", "city", "state", "residential", "keep", "eb", "county")
    return out.select("place", r("eb", 4).alias("value_eb"))


AGENCY = """ag AS (SELECT place, state, county || '-' || (place % 4) AS agency, 500 * (1 + (county * 7 + place % 4 * 13) % 23) AS people,
   1 + (county + place % 4) % 12 AS months, CASE WHEN county % 6 <> 5 THEN ((county * 17 + place % 4 * 29) % 90) * 10.0::DOUBLE END AS rate FROM places)"""


@shared
def agencies(t):
    c, k = F.col("county"), F.col("place") % 4
    return base.places(t).select(
        "place", "state", F.concat_ws("-", c.cast("string"), k.cast("string")).alias("agency"),
        (500 * (1 + (c * 7 + k * 13) % 23)).alias("people"), (1 + (c + k) % 12).alias("months"),
        F.when(c % 6 != 5, ((c * 17 + k * 29) % 90) * 10.0).alias("rate"))


@query("D18", with_(*base.PLACE_SQL, AGENCY, """ae AS (SELECT *, CASE WHEN rate IS NOT NULL THEN people * months / 12.0::DOUBLE / 100000 END AS e FROM ag),
  di AS (SELECT state, agency, max(e) AS e, max(rate * e) AS c FROM ae WHERE e IS NOT NULL GROUP BY ALL),
  mo AS (SELECT state, count(*) AS n, sum(c) / sum(e) AS m, sum(c * c / e) / sum(e) AS q, avg(e) AS me FROM di GROUP BY 1),
  pr AS (SELECT state, m, greatest(q - m * m - m / me, pow(0.1 * m, 2)) AS v FROM mo WHERE n >= 3 AND m > 0)""",
  select=f"SELECT place, {rs('coalesce((rate * e + m * m / v) / (e + m / v), rate)')} AS rate_eb FROM ae LEFT JOIN pr USING (state)"))
def shrunk_rates(t):
    return estimate.shrink_rates(agencies(t), "rate", "people", "months", "agency", "state", "rate_eb").select(
        "place", r("rate_eb").alias("rate_eb"))


@query("D19", with_(*base.PLACE_SQL, EST, SHRINK, select=f"""SELECT place,
  {rs('CASE WHEN value IS NOT NULL AND NOT keep AND value <> 0 THEN value * 1.25 * coalesce(exp(y + se2 / (se2 + tau2) * (mu - y)), value) / value ELSE value * 1.25 END', 4)} AS shown_eb
  FROM mu LEFT JOIN tau USING (state)"""))
def estimate_columns(t):
    out = estimate.shrink_log_medians(estimates(t), "value", "moe", "city", "state", "residential", "keep", "eb", "county").withColumn("today", F.col("value") * 1.25)
    return out.select("place", r(estimate.scaled_estimate("today", "eb", "value", "keep"), 4).alias("shown_eb"))


INDEX = """gm AS (SELECT county, exp(avg(ln(spend))) AS g FROM places WHERE spend > 0 GROUP BY 1),
 ix AS (SELECT place, county, state, spend, population, CASE WHEN county % 3 <> 0 THEN 'metro' ELSE 'state' END AS level,
   CASE WHEN county % 3 <> 0 THEN round(100 * pow(g / 1000000, 1.2), 6) ELSE 90.0::DOUBLE + state END AS part_parent,
   CASE WHEN county % 3 <> 0 THEN round(100 * pow(g / 1000000, 0.24), 6) ELSE 95.0::DOUBLE + state END AS whole_parent
   FROM places LEFT JOIN gm USING (county))"""


@shared
def index_rows(t):
    p = base.places(t)
    gm = p.filter(F.col("spend") > 0).groupBy("county").agg(F.exp(F.avg(F.ln("spend"))).alias("g"))
    metro = F.col("county") % 3 != 0
    return p.join(gm, "county", "left").select(
        "place", "county", "state", "spend", "population", F.when(metro, "metro").otherwise("state").alias("level"),
        F.when(metro, F.round(100 * F.pow(F.col("g") / 1000000, F.lit(1.2)), 6)).otherwise(90.0 + F.col("state")).alias("part"),
        F.when(metro, F.round(100 * F.pow(F.col("g") / 1000000, F.lit(0.24)), 6)).otherwise(95.0 + F.col("state")).alias("whole"))


LOCALIZED = """w AS (SELECT *, greatest(coalesce(population, 0), 1) AS w FROM ix),
  gr AS (SELECT county, exp(sum(w * ln(spend)) / sum(w)) AS ref FROM w WHERE spend > 0 AND level = 'metro' GROUP BY 1),
  sr AS (SELECT state, exp(sum(w * ln(spend)) / sum(w)) AS sref FROM w WHERE spend > 0 GROUP BY 1),
  pa AS (SELECT county, max(part_parent) AS p, max(whole_parent) AS q, max(ref) AS ref FROM w JOIN gr USING (county) WHERE level = 'metro' GROUP BY 1),
  fit AS (SELECT regr_slope(ln(p), ln(ref)) AS b, regr_slope(ln(q), ln(p)) AS g, count(*) AS n FROM pa),
  lo AS (SELECT w.*, b, g, n >= 5 AND b > 0.5 AND b < 2.0 AND g > 0.05 AND g < 0.6 AS ok,
    coalesce(part_parent * pow(CASE WHEN spend > 0 THEN spend / CASE WHEN level = 'metro' THEN ref ELSE sref END END, b), part_parent) AS lp
    FROM w LEFT JOIN gr USING (county) LEFT JOIN sr USING (state), fit)"""


@query("D8 D9 D10", with_(*base.PLACE_SQL, INDEX, LOCALIZED, select=f"""SELECT place, {rs('CASE WHEN ok THEN lp ELSE part_parent END', 4)} AS part,
  {rs('CASE WHEN ok THEN whole_parent * pow(lp / part_parent, g) ELSE whole_parent END', 4)} AS whole, {rs('part_parent', 4)} AS part_parent FROM lo"""))
def localized_index(t):
    out = estimate.localize(index_rows(t), "place", "level", "county", "state", "spend", "population", "part", "whole")
    return out.select("place", r("part", 4).alias("part"), r("whole", 4).alias("whole"), r("part_parent", 4).alias("part_parent"))


@query("D8", with_(*base.PLACE_SQL, select=f"""SELECT county, {rs('exp(sum(greatest(population, 1) * ln(balance)) / sum(greatest(population, 1)))', 4)} AS typical
  FROM places WHERE balance > 0 GROUP BY 1"""))
def weighted_geometric_mean(t):
    return estimate.geometric_mean(base.places(t), ["county"], "balance", "population", "typical").select("county", r("typical", 4).alias("typical"))


@query("D9", with_(*base.PLACE_SQL, select=f"""SELECT {rs('regr_slope(ln(spend), ln(orders))')} AS slope, count(*) AS slope_n FROM places
  WHERE spend > 0 AND orders > 0"""))
def log_log_slope(t):
    return estimate.elasticity(base.places(t), "spend", "orders", "slope").select(r("slope").alias("slope"), "slope_n")


@query("D11 D13", with_(*base.PLACE_SQL, """g AS (SELECT state, segment, median(balance) AS med, count(*) * 10 AS hh FROM places WHERE balance > 0 GROUP BY ALL),
   tt AS (SELECT *, sum(hh) OVER (PARTITION BY state) AS total, CASE WHEN segment = 'FURNITURE' THEN 5 * med WHEN segment = 'HOUSEHOLD' AND state = 1 THEN NULL ELSE 0.2 * med END AS moe FROM g),
   ok AS (SELECT state, CASE WHEN med > 0 AND hh >= 100 AND hh / total >= 0.05 AND moe / 1.645 / med <= 0.4 THEN med END AS m FROM tt)""",
   select=f"SELECT state, {rs('CASE WHEN count(m) >= 2 THEN 100 * min(m) / max(m) END')} AS income_parity FROM ok GROUP BY 1"))
def income_parity(t):
    p = base.places(t).filter(F.col("balance") > 0)
    med = rank.median(p, ["state", "segment"], "balance", "median")
    groups = med.withColumn("households", F.col("n") * 10)
    total = groups.groupBy("state").agg(F.sum("households").alias("total"))
    moe = F.when(F.col("segment") == "FURNITURE", 5 * F.col("median")).when(
        ~((F.col("segment") == "HOUSEHOLD") & (F.col("state") == 1)), 0.2 * F.col("median"))
    rows = groups.join(total, "state").withColumn("moe", moe)
    return estimate.income_parity(rows, "state").select("state", r("income_parity").alias("income_parity"))


@query("D12", with_(*base.PLACE_SQL, """c AS (SELECT state, county, segment, sum(population)::DOUBLE AS c FROM places GROUP BY ALL),
   u AS (SELECT state, county, sum(c) AS t FROM c GROUP BY ALL HAVING sum(c) > 0),
   ue AS (SELECT c.state, c.county, max(t) AS t, sum(CASE WHEN c.c > 0 THEN -(c.c / t) * ln(c.c / t) ELSE 0 END) AS et FROM c JOIN u ON u.state = c.state AND u.county = c.county GROUP BY ALL),
   b AS (SELECT state, count(*) AS n, sum(t) AS tot, sum(t * et) AS wet FROM ue GROUP BY 1),
   g AS (SELECT state, segment, sum(c) AS g FROM c GROUP BY ALL), gs AS (SELECT *, g / sum(g) OVER (PARTITION BY state) AS p FROM g),
   w AS (SELECT state, sum(-p * ln(p)) AS e, 100 * (1 - sum(p * p)) AS dv FROM gs GROUP BY 1)""",
   select=f"SELECT state, {rs('CASE WHEN n >= 4 AND dv >= 15 THEN 100 * (1 - (e - wet / tot) / e) END')} AS integration FROM b JOIN w USING (state)"))
def integration_index(t):
    return estimate.integration(base.places(t), "state", "county", "segment", "population").select("state", r("integration").alias("integration"))


OWNERS = """ow AS (SELECT o_orderkey, c_nationkey AS puma, n_regionkey AS state, o_totalprice AS val, 1 + o_orderkey % 7 AS w,
   o_orderpriority IN ('1-URGENT', '2-HIGH') AS recent,
   round(o_totalprice * (0.01::DOUBLE + (o_orderkey % 9) / 1000.0::DOUBLE + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.002::DOUBLE ELSE 0 END), 2) AS tax
   FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""
SUMS = "sum(w * tax) AS sat, sum(w * val) AS sav, sum(w * tax) FILTER (WHERE recent) AS snt, sum(w * val) FILTER (WHERE recent) AS snv"


@shared
def owners(t):
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(
        t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select(
        k, F.col("c_nationkey").alias("puma"), F.col("n_regionkey").alias("state"), v.alias("val"), (1 + k % 7).alias("w"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("recent"),
        F.round(v * (F.lit(0.01) + (k % 9) / 1000.0 + F.when(urgent, 0.002).otherwise(0.0)), 2).alias("tax"))


@query("D14", with_(OWNERS, f"s AS (SELECT state, puma, {SUMS}, count(*) FILTER (WHERE recent) AS n_recent FROM ow GROUP BY ALL)",
  select=f"SELECT state, puma, {rs('ln((snt / snv) / (sat / sav))')} AS l, n_recent FROM s"))
def recent_rate_ratio(t):
    return estimate.log_rate_ratio(owners(t), ["state", "puma"], "tax", "val", "w", "recent", "l").select(
        "state", "puma", r("l").alias("l"), "n_recent")


REPS = 200


def boot_sql(stream: int = 0) -> str:
    """Resamples by the same hash: a number per record, a step per replicate, mixed again."""
    def mixing(rows: str) -> str:
        for shift, by in ((resample.MIX[0], resample.MIX[1]), (resample.MIX[2], resample.MIX[3]), (resample.MIX[4], 1)):
            rows = f"(SELECT * REPLACE (xor(h, h >> {shift}) * {by}::UBIGINT % 4294967296::UBIGINT AS h) FROM {rows})"
        return rows
    first = mixing(f"(SELECT *, xor(o_orderkey::UBIGINT, {int(resample.mixed(np.array([stream]))[0])}::UBIGINT) AS h FROM ow)")
    second = mixing(f"(SELECT * REPLACE ((h + i::UBIGINT * {resample.STEP}::UBIGINT) % 4294967296::UBIGINT AS h) FROM (SELECT * FROM {first}, range(1, {REPS + 1}) x(i)))")
    times = " ".join(f"WHEN u < {p!r} THEN {k}" for k, p in enumerate(resample.POISSON))
    return f"""rep AS (SELECT *, (h::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM {second}),
  pw AS (SELECT state, puma, i, recent, tax, val, w * CASE {times} ELSE 6 END AS w FROM rep),
  bs AS (SELECT state, puma, i, {SUMS} FROM pw GROUP BY ALL),
  bv AS (SELECT state, puma, var_pop(CASE WHEN sav > 0 AND snv > 0 AND sat > 0 AND snt > 0 THEN ln((snt / snv) / (sat / sav)) END) AS se2 FROM bs GROUP BY ALL)"""


BOOT = boot_sql()


def _variance(t, stream=0):
    return estimate.bootstrap_variance(owners(t), ["state", "puma"], ["o_orderkey"], "tax", "val", "w", "recent", "se2", REPS, F.col("o_orderkey"), stream)


@query("D15", with_(OWNERS, BOOT, select=f"SELECT state, puma, {rs('se2', 9)} AS se2 FROM bv"))
def bootstrap_variance(t):
    return _variance(t).select("state", "puma", r("se2", 9).alias("se2"))


@query("D15", with_(OWNERS, boot_sql(1), select=f"SELECT state, puma, {rs('se2', 9)} AS se2 FROM bv"))
def independent_bootstrap_variance(t):
    """Other draws than ``bootstrap_variance``: what differs between the two is the noise of the replicates."""
    return _variance(t, 1).select("state", "puma", r("se2", 9).alias("se2"))


@query("D16", with_(OWNERS, BOOT, f"""s AS (SELECT state, puma, {SUMS}, count(*) FILTER (WHERE recent) AS n_recent FROM ow GROUP BY ALL),
  st AS (SELECT state, ln((sum(snt) / sum(snv)) / (sum(sat) / sum(sav))) AS state_l FROM s GROUP BY 1),
  p AS (SELECT s.state, s.puma, CASE WHEN n_recent >= 10 THEN ln((snt / snv) / (sat / sav)) END AS l, se2, state_l FROM s JOIN st USING (state)
    JOIN bv ON bv.state = s.state AND bv.puma = s.puma),
  ta AS (SELECT state, greatest(0.0004, coalesce(avg(pow(l - state_l, 2)) - avg(CASE WHEN l IS NOT NULL THEN se2 END), 0.0004)) AS tau2 FROM p GROUP BY 1)""",
  select=f"""SELECT state, puma, {rs('greatest(0.9, least(2.0, exp(CASE WHEN l IS NOT NULL THEN (1 - se2 / (se2 + tau2)) * l + se2 / (se2 + tau2) * state_l ELSE state_l END)))')} AS ratio
  FROM p JOIN ta USING (state)"""))
def new_buyer_ratio(t):
    o = owners(t)
    l = estimate.log_rate_ratio(o, ["state", "puma"], "tax", "val", "w", "recent", "l")
    se = _variance(t)
    states = estimate.log_rate_ratio(o, ["state"], "tax", "val", "w", "recent", "state_l").drop("n_recent")
    hat = estimate.shrink_log_ratios(l.join(se, ["state", "puma"]), "puma", "state", states)
    lo, hi = estimate.RATIO_CLIP
    return hat.select("state", "puma", r(F.greatest(F.lit(lo), F.least(F.lit(hi), F.exp("l_hat")))).alias("ratio"))


CROSSWALK = """tr AS (SELECT n_regionkey * 10 + c_custkey % 7 AS county, n_regionkey AS state, c_nationkey AS puma FROM customer JOIN nation ON n_nationkey = c_nationkey),
  sp AS (SELECT r_regionkey * 10 + k AS county, r_regionkey AS state FROM region, range(0, 9) x(k))"""


@query("D16", with_(OWNERS, BOOT, f"""s AS (SELECT state, puma, {SUMS}, count(*) FILTER (WHERE recent) AS n_recent FROM ow GROUP BY ALL),
  st AS (SELECT state, ln((sum(snt) / sum(snv)) / (sum(sat) / sum(sav))) AS state_l FROM s GROUP BY 1),
  p AS (SELECT s.state, s.puma, n_recent, CASE WHEN n_recent >= 10 THEN ln((snt / snv) / (sat / sav)) END AS l, se2, state_l FROM s JOIN st USING (state)
    JOIN bv ON bv.state = s.state AND bv.puma = s.puma),
  ta AS (SELECT state, greatest(0.0004, coalesce(avg(pow(l - state_l, 2)) - avg(CASE WHEN l IS NOT NULL THEN se2 END), 0.0004)) AS tau2 FROM p GROUP BY 1),
  h AS (SELECT p.*, CASE WHEN l IS NOT NULL THEN (1 - se2 / (se2 + tau2)) * l + se2 / (se2 + tau2) * state_l ELSE state_l END AS l_hat FROM p JOIN ta USING (state))""", CROSSWALK,
  """cl AS (SELECT county, avg(l_hat) AS l FROM tr LEFT JOIN h ON h.state = tr.state AND h.puma = tr.puma GROUP BY 1),
  cn AS (SELECT county, sum(n_recent) AS n FROM (SELECT DISTINCT * FROM tr) tr LEFT JOIN h ON h.state = tr.state AND h.puma = tr.puma GROUP BY 1)""",
  select="""SELECT county::BIGINT AS county, round(greatest(0.9, least(2.0, exp(l))), 3)::DOUBLE AS ratio, n::BIGINT AS sample FROM cl JOIN cn USING (county) WHERE l IS NOT NULL
  UNION ALL SELECT county, round(greatest(0.9, least(2.0, exp(state_l))), 3)::DOUBLE, NULL FROM sp JOIN st USING (state) WHERE county NOT IN (SELECT county FROM tr)"""))
def county_buyer_ratio(t):
    o = owners(t)
    l = estimate.log_rate_ratio(o, ["state", "puma"], "tax", "val", "w", "recent", "l")
    se = _variance(t)
    states = estimate.log_rate_ratio(o, ["state"], "tax", "val", "w", "recent", "state_l").drop("n_recent")
    hat = estimate.shrink_log_ratios(l.join(se, ["state", "puma"]), "puma", "state", states)
    state = F.col("n_regionkey")
    tracts = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        (state * 10 + F.col("c_custkey") % 7).cast("long").alias("county"), state.alias("state"), F.col("c_nationkey").alias("puma"))
    spine = t.region.select(F.col("r_regionkey").alias("state"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).select(
        (F.col("state") * 10 + F.col("k")).cast("long").alias("county"), "state")
    return estimate.county_ratios(hat, tracts, spine, "county", "puma", "state", states)


PRICES = """pr AS (SELECT place, county, state, CASE WHEN place % 29 <> 0 THEN place % 120 END AS zip, CASE WHEN place % 8 <> 0 THEN spend END AS census,
   CASE WHEN place % 120 % 3 <> 0 THEN (500000 + (place % 120) * 9000)::DOUBLE END AS market, place % 31 = 0 AS topped, place % 37 = 0 AS mobile FROM places),
  ra AS (SELECT county, zip, median(market) / median(census) FILTER (WHERE NOT topped AND NOT mobile) AS ratio FROM pr WHERE zip IS NOT NULL GROUP BY ALL),
  rk AS (SELECT * FROM ra WHERE ratio BETWEEN 0.5 AND 3.0), rc AS (SELECT county, median(ratio) AS rc FROM rk GROUP BY 1), rn AS (SELECT median(ratio) AS rn FROM rk)"""


@shared
def prices(t):
    k = F.col("place")
    return base.places(t).select(
        k, "county", "state", F.when(k % 29 != 0, k % 120).alias("zip"), F.when(k % 8 != 0, F.col("spend")).alias("census"),
        F.when(k % 120 % 3 != 0, (500000 + (k % 120) * 9000).cast("double")).alias("market"), (k % 31 == 0).alias("topped"),
        (k % 37 == 0).alias("mobile"))


@query("D20", with_(*base.PLACE_SQL, PRICES, select=f"""SELECT place, {rs('CASE WHEN census IS NOT NULL AND NOT mobile AND NOT (topped AND market IS NOT NULL) THEN census * coalesce(ratio, rc, rn, 1) ELSE market END', 4)} AS today
  FROM pr LEFT JOIN rk ON rk.county = pr.county AND rk.zip = pr.zip LEFT JOIN rc ON rc.county = pr.county, rn"""))
def prices_today(t):
    out = estimate.today_prices(prices(t), "zip", "census", "market", "county", "topped", "mobile", "today")
    return out.select("place", r("today", 4).alias("today"))


@query("D20", with_(*base.PLACE_SQL, PRICES, """rs AS (SELECT *, CASE WHEN market > 0 AND census > 0 THEN market / census END AS q FROM pr WHERE true),
   s AS (SELECT state, median(q) AS sq FROM rs GROUP BY 1), n AS (SELECT median(q) AS nq FROM rs)""",
   select=f"""SELECT place, {rs('CASE WHEN market > 0 THEN market ELSE census * coalesce(sq, nq, 1) END', 4)} AS today,
   CASE WHEN market > 0 THEN 'market' WHEN census IS NOT NULL AND sq IS NOT NULL THEN 'state_ratio' WHEN census IS NOT NULL THEN 'national_ratio' END AS today_source
   FROM rs LEFT JOIN s USING (state), n"""))
def values_today(t):
    return estimate.today_values(prices(t), "state", "census", "market", "today").select(
        "place", r("today", 4).alias("today"), "today_source")


@query("D38", with_(*base.PLACE_SQL, """o AS (SELECT state, balance AS v, sum(population) AS w FROM places WHERE balance IS NOT NULL AND population > 0 GROUP BY ALL),
   c AS (SELECT *, sum(w) OVER (PARTITION BY state ORDER BY v) AS cum, sum(w) OVER (PARTITION BY state) AS tot FROM o)""",
   select="SELECT state, min(v) AS weighted_median FROM c WHERE cum >= tot / 2 GROUP BY 1"))
def weighted_median(t):
    return rank.weighted_median(base.places(t), ["state"], "balance", "population")


@query("D44", with_(*base.PLACE_SQL, select=f"SELECT {rs('median(balance)')} AS balance, {rs('median(spend)')} AS spend, {rs('median(orders)')} AS orders FROM places"))
def typical_values(t):
    long = rank.unpivot(base.places(t), ["place"], ["balance", "spend", "orders"])
    med = rank.median(long, ["metric"], "value")
    return med.groupBy().pivot("metric", ["balance", "spend", "orders"]).agg(F.max("median")).select(
        r("balance").alias("balance"), r("spend").alias("spend"), r("orders").alias("orders"))


@query("D39", with_(*base.PLACE_SQL, "l AS (SELECT 'balance' AS metric, balance AS v FROM places UNION ALL SELECT 'spend', spend FROM places UNION ALL SELECT 'orders', orders FROM places)",
  select=f"SELECT metric, {rs('min(v)')} AS low, {rs('median(v)')} AS median, {rs('max(v)')} AS high FROM l GROUP BY 1"))
def measure_ranges(t):
    long = rank.unpivot(base.places(t), ["place"], ["balance", "spend", "orders"])
    q = rank.exact_quantiles(long, ["metric"], "value", [0.0, 0.5, 1.0], ["low", "median", "high"])
    return q.select("metric", r("low").alias("low"), r("median").alias("median"), r("high").alias("high"))


@query("D48", with_(*base.PLACE_SQL, """o AS (SELECT county, balance, row_number() OVER (PARTITION BY county ORDER BY balance) AS k, count(*) OVER (PARTITION BY county) AS n FROM places WHERE balance IS NOT NULL)""",
  select="SELECT county, balance AS median, row_number() OVER (ORDER BY balance DESC, county) AS position FROM o WHERE k = n // 2 + 1"))
def groups_by_median(t):
    med = rank.upper_median(base.places(t), ["county"], "balance")
    placed = rank.row_positions(med, [], "median", "county", descending=True)
    return placed.select("county", "median", "position")
