"""A household's yearly taxes: property, income and sales, by place and household."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import points as P

# Fixed values.
MEDIAN_HOUSEHOLD_INCOME = 78_538.0
TAXABLE_SPENDING_SHARE = 0.25


def parse_schedule(text: Column | str) -> Column:
    """A compact schedule to struct(none, single, joint, deduction, exemption, credit).

    ``s:0.02@0,0.04@500;m:…;sd:3000,8500;ex:1500,3000;cr:0,0`` or ``none``. NULL if unreadable. Pairs are
    single, then joint; without joint brackets the single ones serve.
    """
    t = F.col(text) if isinstance(text, str) else text
    part = lambda name: F.regexp_extract(t, f"(?:^|;){name}:([^;]*)", 1)
    def brackets(s: Column) -> Column:
        items = F.filter(F.split(s, ","), lambda x: x != "")
        return F.array_sort(F.transform(items, lambda b: F.struct(
            F.get(F.split(b, "@"), 1).try_cast("double").alias("over"), F.get(F.split(b, "@"), 0).try_cast("double").alias("rate"))))
    pair = lambda s: F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.coalesce(
        F.get(F.split(s, ","), i).try_cast("double"), F.lit(0.0)))
    single, joint = brackets(part("s")), brackets(part("m"))
    bad = lambda a: F.exists(a, lambda b: b["over"].isNull() | b["rate"].isNull())
    readable = (F.size(single) > 0) & ~bad(single) & ~bad(joint)
    fields = lambda none, a, b: F.struct(
        F.lit(none).alias("none"), a.alias("single"), b.alias("joint"), pair(part("sd")).alias("deduction"),
        pair(part("ex")).alias("exemption"), pair(part("cr")).alias("credit"))
    empty = F.array().cast("array<struct<over:double,rate:double>>")
    return F.when(F.trim(t) == "none", fields(True, empty, empty)).when(
        readable, fields(False, single, F.when(F.size(joint) > 0, joint).otherwise(single)))


def income_tax(schedule: Column, income: Column, filing: Column) -> Column:
    """Tax over the brackets, after deduction and exemption, less the credit; never negative."""
    k = F.when(filing == "single", 0).otherwise(1)
    rows = F.when(filing == "single", schedule["single"]).otherwise(schedule["joint"])
    taxable = F.greatest(F.lit(0.0), income - F.get(schedule["deduction"], k) - F.get(schedule["exemption"], k))
    def slice_tax(b: Column, i: Column) -> Column:
        top = F.coalesce(F.get(rows, i + 1)["over"], F.lit(float("inf")))
        return b["rate"] * F.greatest(F.lit(0.0), F.least(taxable, top) - b["over"])
    tax = F.aggregate(F.transform(rows, slice_tax), F.lit(0.0), lambda s, x: s + x)
    return F.when(schedule.isNull(), F.lit(None)).when(schedule["none"] | ~(income > 0), 0.0).otherwise(F.greatest(F.lit(0.0), tax - F.get(schedule["credit"], k)))


def household_taxes(rate: Column, new_buyer: Column, typical_home: Column, sales: Column, schedule: Column, tenure: Column,
                    budget: Column, income: Column, filing: Column) -> dict[str, Column]:
    """Property, income and sales tax and their total. NULL when an input the household needs is unknown:
    the schedule and sales rate always, the rate and home unless renting."""
    earned = F.when(income > 0, income).otherwise(MEDIAN_HOUSEHOLD_INCOME)
    renting = F.coalesce(tenure == "rent", F.lit(False))
    home = F.when(renting, F.lit(None)).when((tenure == "buy") & (budget > 0), budget).otherwise(typical_home)
    buyer = F.when(new_buyer > 0, new_buyer).otherwise(1.0)
    known = schedule.isNotNull() & sales.isNotNull() & (renting | (home.isNotNull() & rate.isNotNull()))
    prop = F.when(renting, 0.0).otherwise(rate / 100 * buyer * home)
    inc = income_tax(schedule, earned, F.coalesce(filing, F.lit("joint")))
    sale = sales / 100 * TAXABLE_SPENDING_SHARE * earned
    return {"property": F.when(known, prop), "income_tax": F.when(known, inc), "sales_tax": F.when(known, sale),
            "taxes": F.when(known, prop + inc + sale)}


def with_taxes(places: DataFrame, schedules: DataFrame, state: str, households: DataFrame, rate: str, new_buyer: str, home_today: str,
               home: str, sales: str) -> DataFrame:
    """Each place's taxes per household. ``schedules``: (state, schedule text), one row per state, parsed
    once; ``households``: (search, tenure, budget, income, filing), a short list."""
    parsed = schedules.select(state, parse_schedule("schedule").alias("_s"))
    rows = places.join(parsed, state, "left").join(households, F.lit(True))
    parts = household_taxes(F.col(rate), F.col(new_buyer), F.coalesce(home_today, home), F.col(sales), F.col("_s"), F.col("tenure"),
                            F.col("budget"), F.col("income"), F.col("filing"))
    return rows.withColumns(parts).drop("_s", "tenure", "budget", "income", "filing")


def area_rate(own: str, estimate: str) -> Column:
    """The area's rate: its estimate where both are known, else as published."""
    return F.when(F.col(own).isNotNull() & F.col(estimate).isNotNull(), F.col(estimate)).otherwise(F.col(own))


def with_area_taxes(areas: DataFrame, county: str, counties: DataFrame, schedules: DataFrame, state: str, households: DataFrame,
                    own: str, estimate: str, county_rate: str, new_buyer: str, home_today: str, home: str, sales: str) -> DataFrame:
    """Taxes at the area's own rate in its county; ``taxes_rate`` is the published rate a limit tests."""
    c = counties.select(county, state, F.col(county_rate).alias("_rate"), F.col(new_buyer).alias("_buyer"),
                        F.coalesce(home_today, home).alias("_home"), F.col(sales).alias("_sales"))
    rows = areas.join(c, county)
    mine = area_rate(own, estimate)
    rows = rows.withColumns({"_used": F.coalesce(mine, "_rate"), "taxes_rate": F.coalesce(F.col(own), F.col("_rate")),
                             "rate_source": F.when(mine.isNotNull(), "area").otherwise("county")})
    out = with_taxes(rows, schedules, state, households, "_used", "_buyer", "_home", "_home", "_sales")
    return out.drop("_rate", "_buyer", "_home", "_sales", "_used")


def move_taxes_to_areas(criteria: DataFrame, limits: DataFrame, moved: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """County-level tax weight and limits become area-level rows: (criteria, limits) with a ``level``.

    ``taxes`` scores the area's own bill, lower is better; a property-rate limit tests ``taxes_rate``.
    """
    moved = moved or {"taxes": "taxes", "property_tax_effective_rate": "taxes_rate"}
    taxed = (F.col("level") == "county") & (F.col("metric") == "taxes")
    weight = P.clamp_weight("weight")
    c = criteria.filter(~taxed | (weight > 0)).withColumns({
        "direction": F.when(taxed, "lower").otherwise(F.col("direction")), "weight": F.when(taxed, weight).otherwise(F.col("weight")),
        "level": F.when(taxed, "area").otherwise(F.col("level"))})
    target = F.lit(None).cast("string")
    for a, b in moved.items():
        target = F.when((F.col("level") == "county") & (F.col("metric") == a), b).otherwise(target)
    out = limits.withColumn("_t", target).withColumns({
        "level": F.when(F.col("_t").isNotNull(), "area").otherwise(F.col("level")), "metric": F.coalesce("_t", "metric")}).drop("_t")
    return c, out


def rate_spread(areas: DataFrame, county: str, rate: str, flag: Column) -> DataFrame:
    """Lowest and highest trusted rate per county, where at least three areas have one."""
    trusted = F.when(~F.coalesce(flag, F.lit(False)) & (F.col(rate) > 0), F.col(rate))
    return areas.groupBy(county).agg(F.count(trusted).alias("_n"), F.min(trusted).alias("lowest"), F.max(trusted).alias("highest")).select(
        county, F.when(F.col("_n") >= 3, F.col("lowest")).alias("lowest"), F.when(F.col("_n") >= 3, F.col("highest")).alias("highest"))
