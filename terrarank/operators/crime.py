"""Incident records to agency rates, and what an area may claim of an agency's rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_county_agency
from ..functions.values import half_up_floor
from ..session import DEFAULT_LIMITS, Limits
from . import rank

# When a rate can be computed at all, and when it is not an area's own.
MIN_MONTHS = 3
MIN_EXPOSURE = 2_500
CITY_WIDE_AREAS = 100
WIDE_MIN_AREAS = 8
WIDE_DENSITY_SPREAD = 10.0
MIN_POPULATION_SHARED = 50


def reduce_incidents(agencies: DataFrame, months: DataFrame, offenses: DataFrame, incidents: DataFrame, victims: DataFrame,
                     violent: Sequence[str], property_: Sequence[str], per_offense: Sequence[str]) -> DataFrame:
    """One row per agency: months reported, violent and property counts.

    Violent offenses count once per victim (one where none is listed), except those counted per offense.
    Victims are counted per offense before the join; everything else is partial sums.
    """
    kept = offenses.filter(F.col("offense_code").isin(*violent, *property_))
    per = victims.groupBy("offense_id").agg(F.count("*").alias("_v"))
    rows = kept.join(incidents.select("incident_id", "agency_id"), "incident_id").join(per, "offense_id", "left")
    code = F.col("offense_code")
    v = F.when(code.isin(*per_offense), 1).when(code.isin(*violent), F.coalesce("_v", F.lit(1))).otherwise(0)
    counts = rows.groupBy("agency_id").agg(F.sum(v).alias("violent"), F.count_if(code.isin(*property_)).alias("property"))
    reported = months.groupBy("agency_id").agg(F.count_distinct("month_num").alias("months"))
    zero = F.lit(0).cast("long")
    out = agencies.join(reported, "agency_id", "left").join(counts, "agency_id", "left")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("months", "violent", "property")})


def yearly_rate(count: str, population: str, months: str) -> Column:
    """Per 100,000 people a year; a partial year is scaled up."""
    ok = (F.col(population) > 0) & (F.col(months) > 0)
    return F.when(ok, F.col(count) * (100_000 * 12) / (F.col(population) * F.col(months)))


def crimes_reported(rate: str, population: str, months: str) -> Column:
    return half_up_floor(F.col(rate) * F.col(population) * F.coalesce(F.col(months), F.lit(12)) / 12 / 100_000).cast("long")


def rate_note(population: str, months: str, violent_rate: str, property_rate: str, implausible_population: float = 50_000,
              implausible_rate: float = 20.0, quiet_population: float = 5_000, quiet_rate: float = 100.0) -> Column:
    """Why an agency's counts cannot be a rate, NULL when they can: ``months``, ``exposure`` or
    ``implausible``."""
    p, m, v, q = F.col(population), F.col(months), F.col(violent_rate), F.col(property_rate)
    safe = (p >= implausible_population) & (v < implausible_rate) & ~F.coalesce(q >= 500, F.lit(False))
    quiet = (p >= quiet_population) & F.coalesce(q < quiet_rate, F.lit(False))
    nothing = (p >= 5_000) & F.coalesce(q == 0, F.lit(False))
    return (F.when(m < MIN_MONTHS, "months").when(p * m / 12 < MIN_EXPOSURE, "exposure")
            .when(p.isNotNull() & v.isNotNull() & (safe | quiet | nothing), "implausible"))


def most_complete(records: DataFrame, key: Sequence[str], months: str, year: str, then: Sequence[Column] = ()) -> DataFrame:
    """Each agency's record with the most months, the newest year first among equals."""
    return rank.first_per_group(records, key, [F.desc(months), F.desc(year), *then])


def largest_record(records: DataFrame, key: Sequence[str], size: str, then: Sequence[Column] = ()) -> DataFrame:
    """One record per key: the one with the most offenses."""
    return rank.first_per_group(records, key, [F.desc(size), *then])


def combine_patrols(agencies: DataFrame, county: str, kind: str) -> DataFrame:
    """Counties policed by several kinds of agency: counts and people summed, the fewest months kept."""
    g = agencies.groupBy(county).agg(
        F.count_distinct(kind).alias("_kinds"), F.sum("population").alias("population"), F.min("months").alias("months"),
        F.sum("violent").alias("violent"), F.sum("property").alias("property"))
    return g.filter(F.col("_kinds") > 1).drop("_kinds")


def shared_rates(areas: DataFrame, key: str, county: str, agency: str, density: str, population: str, rate: str,
                 limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """How many residential areas of the county share an area's agency rate, and whether a county agency's
    one rate spans farmland and suburbs (``crime_wide``).

    Counted per agency and joined back; the density spread is an exact quantile pair.
    """
    rated = F.col(rate).isNotNull()
    live = areas.filter(rated & (F.coalesce(population, F.lit(0)) > MIN_POPULATION_SHARED) & F.col(agency).isNotNull())
    counts = live.groupBy(county, agency).agg(F.count("*").alias("crime_shared"))
    q = rank.exact_quantiles(live, [county, agency], density, [0.1, 0.9], ["_p10", "_p90"], limits).drop("n")
    groups = counts.join(q, [county, agency], "left")
    wide = is_county_agency(agency) & (F.col("crime_shared") >= WIDE_MIN_AREAS) & (
        F.col("_p90") >= WIDE_DENSITY_SPREAD * F.greatest(F.col("_p10"), F.lit(1.0)))
    groups = groups.withColumn("crime_wide", F.coalesce(wide, F.lit(False))).drop("_p10", "_p90")
    out = areas.join(groups, [county, agency], "left")
    return out.withColumns({"crime_shared": F.when(rated, F.col("crime_shared")),
                            "crime_wide": F.coalesce(F.col("crime_wide"), F.lit(False)) & rated})


def owns_rate(wide: Column, shared: Column, violent: Column, property_: Column) -> Column:
    """The area has a rate of its own: not a county's, not a big city's, and not a report of nothing."""
    reported = violent.isNotNull() & ~((violent == 0) & F.coalesce(property_ == 0, F.lit(False)))
    return ~F.coalesce(wide, F.lit(False)) & (F.coalesce(shared, F.lit(0)) < CITY_WIDE_AREAS) & reported


def county_agencies(areas: DataFrame, county: str, agency: str) -> DataFrame:
    """Each agency of a county with a usable rate, once, with the people it serves."""
    return areas.filter(_usable()).groupBy(county, agency).agg(F.max("people").alias("people"), F.count("*").alias("areas"))


def _usable() -> Column:
    v, p = F.col("violent_rate"), F.col("property_rate")
    return F.coalesce(v.isNotNull() & ~((v == 0) & F.coalesce(p == 0, F.lit(False))), F.lit(False))


def crime_view(areas: DataFrame, key: str, county: str, agency: str) -> DataFrame:
    """What to show about crime per area — ``own``, ``city``, ``nearby`` or ``none`` — and how many other
    agencies of the county a ``nearby`` view lists (they are rows of :func:`county_agencies`)."""
    listed = county_agencies(areas, county, agency).groupBy(county).agg(F.count("*").alias("_agencies"))
    rows = areas.join(listed, county, "left").withColumn("_ok", _usable())
    others = F.coalesce("_agencies", F.lit(0)) - F.when(F.col("_ok"), 1).otherwise(0)
    mine = F.col("_ok") & ~F.coalesce(F.col("crime_wide"), F.lit(False))
    view = F.when(mine & (F.col("crime_shared") >= CITY_WIDE_AREAS), "city").when(mine, "own").when(
        F.col("_ok") | (others > 0), "nearby").otherwise("none")
    return rows.withColumns({"view": view, "others": F.when(view == "nearby", others)}).drop("_agencies", "_ok")


def months_with_reports(wide: DataFrame, key: str, month_columns: dict[str, str], violent: Sequence[str], property_: Sequence[str],
                        category_of: dict[str, str]) -> DataFrame:
    """From month columns per offense category: months with anything reported, and sums per class."""
    long = wide.unpivot([key], list(month_columns), "column", "n")
    m = F.create_map(*[x for c, month in month_columns.items() for x in (F.lit(c), F.lit(month))])
    cat = F.create_map(*[x for c, name in category_of.items() for x in (F.lit(c), F.lit(name))])
    long = long.select(key, m[F.col("column")].alias("month"), cat[F.col("column")].alias("category"), F.coalesce("n", F.lit(0)).alias("n"))
    by_month = long.groupBy(key, "month").agg(
        F.sum("n").alias("_all"), F.sum(F.when(F.col("category").isin(*violent), F.col("n")).otherwise(0)).alias("_v"),
        F.sum(F.when(F.col("category").isin(*property_), F.col("n")).otherwise(0)).alias("_p"))
    return by_month.groupBy(key).agg(F.count_if(F.col("_all") > 0).alias("months"), F.sum("_v").alias("violent"), F.sum("_p").alias("property"))
