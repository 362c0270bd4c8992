"""Data-quality checks. Each returns findings ``(severity, check, key, message)``; FAIL or BLOCK stops a
publish. Checks over one table are folded into one aggregation where they can be.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_date
from ..session import DEFAULT_LIMITS, Limits
from . import facts as FX
from . import rank

STOPPING = ["FAIL", "BLOCK"]


def _finding(df: DataFrame, severity: Column | str, check: str, key: Column | str, message: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    k = F.lit(key) if isinstance(key, str) else key
    return df.select(sev.alias("severity"), F.lit(check).alias("check"), k.cast("string").alias("key"), message.alias("message"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def union(findings: Sequence[DataFrame]) -> DataFrame:
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out


def stops(findings: DataFrame) -> bool:
    """Whether anything stops the publish: reads at most one row."""
    return findings.filter(F.col("severity").isin(*STOPPING)).limit(1).count() > 0


def row_count(df: DataFrame, low: int, high: int) -> DataFrame:
    n = df.agg(F.count("*").alias("n"))
    sev = F.when((F.col("n") < low) | (F.col("n") > high), "FAIL").otherwise("INFO")
    return _finding(n, sev, "row count", "", _text(F.col("n"), f" rows, expected {low} to {high}"))


def key_integrity(df: DataFrame, key: str, width: int, low_band: Column, least_low: int, group: str, least_groups: int) -> DataFrame:
    """Duplicates, wrong widths, a missing low band (the lost leading zero), too few groups."""
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"), F.any_value(group).alias(group))
    n = per_key.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("dup"),
        F.coalesce(F.sum(F.when(F.length(F.col(key).cast("string")) != width, F.col("_n"))), F.lit(0)).alias("width"),
        F.coalesce(F.sum(F.when(low_band, F.col("_n"))), F.lit(0)).alias("low"), F.count_distinct(group).alias("groups"))
    return union([
        _finding(n.filter("dup > 0"), "FAIL", "key", "duplicate", _text(F.col("dup"), " rows share a key")),
        _finding(n.filter("width > 0"), "FAIL", "key", "width", _text(F.col("width"), f" keys are not {width} wide")),
        _finding(n.filter(F.col("low") < least_low), "FAIL", "key", "low band", _text("only ", F.col("low"), " rows in the low band")),
        _finding(n.filter(F.col("groups") < least_groups), "FAIL", "key", "groups", _text("only ", F.col("groups"), " groups")),
    ])


def join_rates(df: DataFrame, markers: Mapping[str, str], low_band: Column, fail_below: float = 0.05) -> DataFrame:
    """Share of rows each source matched, overall and per key band; a threefold gap is a broken key."""
    aggs = []
    for name, c in markers.items():
        hit = F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)
        aggs.append(F.struct(F.lit(name).alias("source"), F.avg(hit).alias("all"), F.coalesce(F.avg(F.when(low_band, hit)), F.lit(1.0)).alias("low"),
                             F.coalesce(F.avg(F.when(~low_band, hit)), F.lit(1.0)).alias("high")).alias(name))
    rates = df.agg(*aggs).select(F.explode(F.array(*markers)).alias("r")).select("r.*")
    broken = (F.col("high") > 0.5) & (F.col("low") < F.col("high") / 3)
    sev = F.when(F.col("all") < fail_below, "FAIL").when(broken, "FAIL").when(F.col("all") < 0.8, "WARN").otherwise("INFO")
    return _finding(rates, sev, "join rate", F.col("source"), _text("joined ", F.round(100 * F.col("all"), 1), "% of rows"))


def null_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns more than half unknown, or more than a tenth."""
    rates = df.agg(*[F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias(c) for c in columns]).unpivot([], list(columns), "column", "rate")
    sev = F.when(F.col("rate") > 0.5, "WARN").otherwise("INFO")
    return _finding(rates.filter("rate > 0.1"), sev, "coverage", F.col("column"), _text(F.round(100 * F.col("rate"), 1), "% unknown"))


def plausible_ranges(df: DataFrame, key: str, ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values outside each column's range, with up to three examples. ``ranges``: (metric, low, high)."""
    long = rank.unpivot(df, [key], columns).join(ranges, "metric")
    bad = long.filter((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))
    counts = bad.groupBy("metric").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    examples = rank.top_k(bad, ["metric"], [F.asc(key)], 3).groupBy("metric").agg(F.array_sort(F.collect_list(F.col(key))).alias("ex"))
    out = counts.join(examples, "metric")
    return _finding(out, "WARN", "range", F.col("metric"), _text(F.col("n"), " outside, e.g. ", F.array_join(F.col("ex").cast("array<string>"), ",")))


def escaped_sentinels(df: DataFrame, money: Sequence[str]) -> DataFrame:
    """Negative values in money columns mean a marker got through."""
    packed = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c) < 0).alias("n"), F.min(c).cast("double").alias("low")).alias(c) for c in money]
    rows = df.agg(*packed).select(F.explode(F.array(*money)).alias("r")).select("r.*").filter("n > 0")
    return _finding(rows, "FAIL", "sentinel", F.col("column"), _text(F.col("n"), " negative values, lowest ", F.round("low", 2)))


def expectations(df: DataFrame, key: str, spots: DataFrame, predicates: Sequence[tuple[str, str]]) -> DataFrame:
    """Known places: required keys (``spots``: key, what) and predicates (name, SQL expression over the row)."""
    missing = spots.join(df.select(key).distinct(), key, "left_anti")
    out = [_finding(missing, "FAIL", "spot", F.col(key), _text("missing: ", F.col("what")))]
    mine = df.join(spots, key)
    for name, expression in predicates:
        bad = mine.filter(~F.coalesce(F.expr(expression), F.lit(False)))
        out.append(_finding(bad, "FAIL", "spot", F.col(key), _text(f"failed: {name}")))
    return union(out)


def category_mix(df: DataFrame, column: str, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Shares of a category's values against bounds."""
    aggs = [F.avg(F.when(F.col(column) == v, 1.0).otherwise(0.0)).alias(v) for v in bounds]
    shares = df.agg(*aggs).unpivot([], list(bounds), "value", "share")
    outside = F.lit(False)
    for v, (low, high) in bounds.items():
        outside = outside | ((F.col("value") == v) & ((F.col("share") < low) | (F.col("share") > high)))
    return _finding(shares, F.when(outside, "FAIL").otherwise("INFO"), "mix", F.col("value"), _text(F.round(100 * F.col("share"), 1), "%"))


def derived_matches(df: DataFrame, column: str, definition: Column, tolerance: float, band: tuple[float, float],
                    limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """A derived column equals its definition, and its median lies in the usual band."""
    off = df.filter(F.col(column).isNotNull()).agg(F.count_if(F.coalesce(F.abs(F.col(column) - definition) > tolerance, F.lit(True))).alias("n"))
    med = rank.median(df, [], column, "m", limits)
    return union([
        _finding(off.filter("n > 0"), "FAIL", "derived", column, _text(F.col("n"), " rows do not match the definition")),
        _finding(med.filter((F.col("m") < band[0]) | (F.col("m") > band[1])), "WARN", "derived", column, _text("median ", F.round("m", 1), " outside the usual band")),
    ])


def monthly_reproduces(monthly: DataFrame, yearly: DataFrame, key: str, checks: Mapping[str, tuple[str, str]], tolerance: float,
                       pair: tuple[str, str] | None = None) -> DataFrame:
    """Exactly months 1–12 per place, yearly figures reproduced from months, no inverted pair.

    ``checks``: yearly column -> (monthly column, how).
    """
    from .climate import SEASONS, season

    per = monthly.groupBy(key).agg(
        F.count("*").alias("_n"), F.count_distinct("month").alias("_d"), F.min("month").alias("_lo"), F.max("month").alias("_hi"),
        F.coalesce(F.max(F.when(F.col(pair[1]) > F.col(pair[0]), 1)), F.lit(0)).alias("_inv") if pair else F.lit(0).alias("_inv"),
        *[season(SEASONS["year"], c, how).alias(f"_y_{out}") for out, (c, how) in checks.items()])
    bad = per.agg(F.count_if((F.col("_n") != 12) | (F.col("_d") != 12) | (F.col("_lo") != 1) | (F.col("_hi") != 12)).alias("n"), F.sum("_inv").alias("inv"))
    out = [_finding(bad.filter("n > 0"), "FAIL", "monthly", "months", _text(F.col("n"), " places without exactly months 1-12")),
           _finding(bad.filter("inv > 0"), "FAIL", "monthly", "inverted", _text(F.col("inv"), " places with a low above the high"))]
    both = yearly.join(per, key)
    off = both.agg(*[F.count_if(F.abs(F.col(c) - F.col(f"_y_{c}")) > tolerance).alias(c) for c in checks]).unpivot([], list(checks), "column", "n")
    out.append(_finding(off.filter("n > 0"), "FAIL", "monthly", F.col("column"), _text(F.col("n"), " places differ from their months")))
    gone = yearly.join(per, key, "left_anti").agg(F.count("*").alias("n")).filter("n > 0")
    out.append(_finding(gone, "FAIL", "monthly", "no months", _text(F.col("n"), " places have yearly figures but no months")))
    return union(out)


def fact_schema(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """Undeclared laws, status, confidence, values outside the allowed set, numbers that are not."""
    j = values.join(definitions.withColumn("_known", F.lit(True)), "law", "left")
    key = _text(F.col("law"), "/", F.col("state"))
    filled = F.trim(F.coalesce("value", F.lit(""))) != ""
    allowed = F.split(F.coalesce("allowed", F.lit("")), r"\|")
    known = F.col("_known").isNotNull()
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    rules = [
        (~known, "law is not declared"),
        (known & has("status") & ~F.trim("status").isin(*FX.STATUSES), "status is not valid"),
        (known & has("confidence") & ~F.trim("confidence").isin(*FX.CONFIDENCES), "confidence is not valid"),
        (known & filled & F.col("type").isin("nominal", "ordinal", "boolean") & has("allowed") & ~F.array_contains(allowed, F.trim("value")), "value is not in the allowed set"),
        (known & filled & (F.col("type") == "numeric") & F.col("value_numeric").try_cast("double").isNull(), "numeric law has no number"),
        (known & filled & (F.col("type") == "ordinal") & ~has("order"), "ordinal law has no order"),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.lit(m)) for cond, m in rules]))
    rows = j.select(key.alias("k"), F.explode(found).alias("m"))
    return _finding(rows, "BLOCK", "schema", F.col("k"), F.col("m"))


def fact_coverage(values: DataFrame, definitions: DataFrame, states: DataFrame) -> DataFrame:
    """States absent per law (BLOCK), and laws empty or partly filled (WARN)."""
    asked = definitions.filter(~F.startswith(F.col("tier"), F.lit("A")))
    n = states.agg(F.count("*").alias("_all"))
    mine = values.join(states.select("state"), "state", "left_semi").groupBy("law").agg(
        F.count_distinct("state").alias("_seen"), F.count_if(F.trim(F.coalesce("value", F.lit(""))) != "").alias("_filled"))
    j = asked.select("law").join(mine, "law", "left").na.fill(0, ["_seen", "_filled"]).join(F.broadcast(n), F.lit(True))  # one row
    absent = j.filter(F.col("_seen") < F.col("_all"))
    part = j.filter(F.col("_filled") < F.col("_all"))
    return union([
        _finding(absent, "BLOCK", "coverage", F.col("law"), _text(F.col("_all") - F.col("_seen"), " jurisdictions absent")),
        _finding(part, "WARN", "coverage", F.col("law"), F.when(F.col("_filled") == 0, "no values filled in yet").otherwise(
            _text("partially filled: ", F.col("_filled"), "/", F.col("_all")))),
    ])


def fact_age(values: DataFrame, definitions: DataFrame, today: Column) -> DataFrame:
    """Values without a date, past the hard expiry, past their cadence, or scheduled changes that are due."""
    j = values.filter(F.trim(F.coalesce("value", F.lit(""))) != "").join(definitions.select("law", "cadence"), "law")
    age = F.datediff(today, parse_date("as_of"))
    due = (F.col("status") == "scheduled") & (parse_date("effective_date") <= today)
    limit = FX.cadence_days("cadence")
    dated = (F.when(age.isNull(), F.struct(F.lit("BLOCK").alias("s"), F.lit("no as-of date").alias("m")))
             .when(age > FX.HARD_EXPIRY_DAYS, F.struct(F.lit("BLOCK").alias("s"), _text("unreviewed for ", age, " days").alias("m")))
             .when(age > limit, F.struct(F.lit("WARN").alias("s"), _text("unreviewed for ", age, " days, limit ", limit).alias("m"))))
    sched = F.when(due & age.isNotNull(), F.struct(F.lit("BLOCK").alias("s"), F.lit("scheduled change is in effect").alias("m")))
    rows = j.select(_text(F.col("law"), "/", F.col("state")).alias("k"), F.explode(F.array_compact(F.array(dated, sched))).alias("f"))
    return _finding(rows, F.col("f.s"), "staleness", F.col("k"), F.col("f.m"))


def fact_provenance(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """Values without source, date, address or quote."""
    j = values.filter(F.trim(F.coalesce("value", F.lit(""))) != "").join(definitions.select("law"), "law", "left_semi")
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    notes = F.lower(F.coalesce("notes", F.lit("")))
    rules = [
        ("BLOCK", ~has("source_name"), "no source name"), ("BLOCK", parse_date("source_date").isNull(), "no source date"),
        ("BLOCK", ~has("source_url"), "no source address"), ("BLOCK", has("source_url") & ~F.lower(F.trim("source_url")).rlike("^https?://"), "source address is not an address"),
        ("WARN", ~has("source_quote"), "no quote"), ("WARN", has("source_quote") & (F.length(F.trim("source_quote")) < 20), "quote too short"),
        ("WARN", (F.col("status") == "enjoined") & ~notes.contains("enjoin") & ~notes.contains("court"), "no court action noted"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("s"), F.lit(m).alias("m"))) for s, c, m in rules]))
    rows = j.select(_text(F.col("law"), "/", F.col("state")).alias("k"), F.explode(found).alias("f"))
    return _finding(rows, F.col("f.s"), "provenance", F.col("k"), F.col("f.m"))


def fact_editions(values: DataFrame, definitions: DataFrame, today: Column) -> DataFrame:
    """Laws whose source is over two years old, or whose address cites a past edition of a yearly table."""
    old = values.filter(F.datediff(today, parse_date("source_date")) > FX.SOURCE_MAX_AGE_DAYS).groupBy("law").agg(
        F.min(parse_date("source_date")).alias("d"))
    yearly = definitions.filter(F.startswith(F.col("tier"), F.lit("B1"))).select("law")
    years = F.transform(F.regexp_extract_all("source_url", F.lit(r"(20\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    cited = values.filter(F.trim(F.coalesce("value", F.lit(""))) != "").join(yearly, "law", "left_semi").groupBy("law", "source_url").agg(
        F.max(F.array_max(years)).alias("y")).filter(F.col("y") < F.year(today))
    return union([_finding(old, "WARN", "edition", F.col("law"), _text("source dated ", F.col("d"))),
                  _finding(cited, "WARN", "edition", F.col("law"), _text("cites the ", F.col("y"), " edition"))])


def freshness(sources: DataFrame, today: Column, stale_days: int = 62) -> DataFrame:
    """Sources carried over or overdue. ``sources``: (source, computed date, carried)."""
    overdue = F.coalesce(F.datediff(today, F.col("computed")) > stale_days, F.lit(False))
    return sources.select("source", "computed", "carried", (overdue | F.col("carried")).alias("stale"))


def due_dates(checks: DataFrame, today: Column) -> DataFrame:
    """When each recurring check is due: the earlier of its interval and its fixed date, and whether it is."""
    due = F.least(F.date_add("last_done", F.col("every_days")), F.col("fixed_date"))
    return checks.withColumn("due", due).withColumn("is_due", F.col("due") <= today)


def coverage_report(areas: DataFrame, county: str, population: str, columns: Mapping[str, Column]) -> DataFrame:
    """% of populated areas with a value, per county and measure."""
    live = F.coalesce(F.col(population) > 0, F.lit(False))
    n = F.greatest(F.count_if(live), F.lit(1))
    return areas.groupBy(county).agg(
        F.count("*").alias("areas"), F.count_if(live).alias("populated"),
        *[F.bround(100 * F.count_if(live & cond) / n).alias(name) for name, cond in columns.items()])


def coverage_floors(report: DataFrame, floors: DataFrame, measures: Sequence[str], state: str, failed: Column, max_failed_share: float = 0.01,
                    max_failed: int = 3) -> DataFrame:
    """National coverage under its floor fails, a state under half its floor warns, too many failed counties
    fail. ``floors``: (measure, floor)."""
    ok = report.filter(~failed)
    long = ok.select(state, "populated", *[F.col(m).cast("double").alias(m) for m in measures]).unpivot([state, "populated"], list(measures), "measure", "pct")
    v, w = F.coalesce("pct", F.lit(0.0)), F.coalesce("populated", F.lit(0))
    share = F.sum(v * w) / F.greatest(F.sum(w), F.lit(1))
    nat = long.groupBy("measure").agg(share.alias("pct")).join(floors, "measure").filter(F.col("pct") < F.col("floor"))
    by_state = long.groupBy(state, "measure").agg(share.alias("pct")).join(floors, "measure").filter(F.col("pct") < F.col("floor") / 2)
    count = report.agg(F.count("*").alias("n"), F.count_if(failed).alias("bad"))
    too_many = count.filter(F.col("bad") > F.greatest(F.lit(max_failed), F.floor(F.col("n") * max_failed_share)))
    return union([
        _finding(nat, "FAIL", "floor", F.col("measure"), _text(F.round("pct", 1), "% covered, floor ", F.round("floor", 1))),
        _finding(by_state, "WARN", "floor", _text(F.col(state), "/", F.col("measure")), _text(F.round("pct", 1), "% covered")),
        _finding(too_many, "FAIL", "floor", "failed", _text(F.col("bad"), " of ", F.col("n"), " failed")),
    ])


def subset_equals_full(full: DataFrame, subset: DataFrame, key: str, value: str, digits: int = 9) -> DataFrame:
    """A part computed alone gives the values of the whole run: one finding row per differing key."""
    j = subset.select(key, F.col(value).alias("_s")).join(full.select(key, F.col(value).alias("_f")), key, "left")
    bad = j.filter(~F.round("_s", digits).eqNullSafe(F.round("_f", digits)))
    return _finding(bad, "FAIL", "subset", F.col(key), _text("alone ", F.col("_s"), ", whole run ", F.col("_f")))


def audit_results(shown: DataFrame, key: str, values: DataFrame, limits: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Points, beats and must-haves of listed results derived again from the values alone.

    ``shown``: (search, key, metric, value, direction, weight, points, beats, score) of a report's results. The
    distribution is counted again from the values, with the listed ones among them at no count of their own, so a
    report may be of any length.
    """
    listed = shown.select("metric", F.col("value").alias("_v")).filter(F.col("_v").isNotNull()).distinct().withColumn("_c", F.lit(0).cast("long"))
    all_values = values.groupBy("metric", F.col("value").alias("_v")).agg(F.count("*").alias("_c"))
    both = all_values.unionByName(listed).groupBy("metric", "_v").agg(F.sum("_c").alias("_c"))
    counted = rank.running_totals(both, ["metric"], "_v", ["_c"]).select(
        "metric", "_v", F.col("_c_total").alias("_n"), F.col("_c_before").alias("_below"), (F.col("_c_before") + F.col("_c")).alias("_upto"))
    j = shown.join(counted, (shown["metric"] == counted["metric"]) & (shown["value"] == counted["_v"])).drop(counted["metric"])
    lo, hi = 100 * F.col("_below") / (F.col("_n") - 1), 100 * (F.col("_upto") - 1) / (F.col("_n") - 1)
    want = F.when(F.col("direction") == "higher", hi).when(F.col("direction") == "lower", 100 - lo).otherwise(100 - 2 * F.abs((lo + hi) / 2 - 50))
    want_beats = F.when(F.col("direction") == "higher", lo).when(F.col("direction") == "lower", 100 - hi)
    name = _text(F.col(key), "/", F.col("metric"))
    wrong = j.filter(F.coalesce(F.abs(want - F.col("points")) > tolerance, F.lit(True)))
    false_beats = j.filter((F.col("direction") != "middle") & F.coalesce(F.abs(want_beats - F.col("beats")) > tolerance, F.lit(True)))
    leaks = shown.join(limits, ["search", "metric"]).filter((F.col("value") < F.col("min")) | (F.col("value") > F.col("max")))
    score = shown.groupBy("search", key).agg(
        (F.sum(F.col("weight") * F.coalesce("points", F.lit(50.0))) / F.sum("weight")).alias("_want"), F.max("score").alias("_got"))
    off = score.filter(F.abs(F.col("_want") - F.col("_got")) > 1e-6)
    return union([
        _finding(wrong, "FAIL", "audit", name, F.lit("points contradict the value")), _finding(false_beats, "FAIL", "audit", name, F.lit("beats contradicts the value")),
        _finding(leaks, "FAIL", "audit", name, F.lit("must-have leak")), _finding(off, "FAIL", "audit", F.col(key), F.lit("score is not the weighted average of its parts")),
    ])


def list_shape(top: DataFrame, state: str, population: str) -> DataFrame:
    """Warnings on a result list: many tied for first, one state holding most, small places."""
    n = top.groupBy("search").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    tied = top.join(n, "search").filter(F.abs(F.col("score") - F.col("best")) < 1e-9).groupBy("search").agg(F.count("*").alias("k")).filter("k > 10")
    states = top.groupBy("search", state).agg(F.count("*").alias("k")).join(n, "search").filter(F.col("k") > 0.6 * F.col("n"))
    small = top.groupBy("search").agg(F.percentile(population, 0.1).alias("p")).filter("p < 1000")  # a listed page of results
    return union([
        _finding(tied, "WARN", "list", F.col("search"), _text(F.col("k"), " results tied for first")),
        _finding(states, "WARN", "list", F.col("search"), _text("one state holds ", F.col("k"), " of ", F.col("n"))),
        _finding(small, "WARN", "list", F.col("search"), _text("a tenth of results have under ", F.round("p").cast("long"), " residents"))])


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Rows pass through; one that breaks the condition fails the job while it is read."""
    return df.filter(F.assert_true(F.coalesce(condition, F.lit(False)), F.lit(message)).isNull())


def profile(df: DataFrame, columns: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Unknowns, lowest, median and highest per numeric column."""
    packed = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count("*").alias("rows"), F.min(c).cast("double").alias("low"),
                       F.max(c).cast("double").alias("high")).alias(c) for c in columns]
    base = df.agg(*packed).select(F.explode(F.array(*columns)).alias("r")).select("r.*")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    med = rank.median(long, ["column"], "value", "median", limits).drop("n")
    return base.join(med, "column", "left")


def text_profile(df: DataFrame, key: str, columns: Sequence[str], samples: int = 3) -> DataFrame:
    """Unknowns and the first known values, in order of ``key``, per text column.

    ``samples`` is a report length: each task sends at most that many rows per column.
    """
    counts = df.agg(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count("*").alias("rows")).alias(f"_{k}")
                      for k, c in enumerate(columns)]).select(F.explode(F.array(*[f"_{k}" for k in range(len(columns))])).alias("r")).select("r.*")
    long = df.select(F.col(key).alias("_key"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["_key"], list(columns), "column", "_value")
    first = rank.top_k(long.filter(F.col("_value").isNotNull()), ["column"], [F.asc("_key"), F.asc("_value")], samples, "_pos")
    shown = first.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_value"))), lambda x: x["_value"]).alias("samples"))
    return counts.join(shown, "column", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
