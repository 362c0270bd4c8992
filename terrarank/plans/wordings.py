"""Display text of the verdicts, as rows, and the columns that fill them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.values import col, half_up_floor

# Cuts (operator, limit, words), the words past the last cut, and those for an unknown value.
HAZARD = ([("<", 20, "Very low"), ("<", 40, "Low"), ("<", 60, "Moderate"), ("<", 80, "High")], "Very high")
SCHOOLS = ([("<", 25, "Weak schools"), ("<", 40, "Below average"), ("<", 60, "About average"), ("<", 75, "Above average")], "Strong schools")
SAFETY = ([("<", 0.6, "Much safer than a typical US area"), ("<", 0.9, "Safer than a typical US area"),
           ("<=", 1.15, "About as safe as a typical US area"), ("<=", 2, "More crime than a typical US area")],
          "Much more crime than a typical US area")
DIVERSITY = ([("<", 20, "Mostly one group"), ("<", 40, "Somewhat diverse"), ("<", 60, "Diverse")], "Very diverse")
INCOME_GAP = ([("<", 0.38, "Incomes fairly even"), ("<=", 0.46, "A typical income gap"), ("<=", 0.52, "A wide income gap")],
              "A very wide income gap")
PM25 = ([("<=", 5, "Very clean air (PM2.5 {pm})"), ("<=", 7, "Clean air (PM2.5 {pm})"), ("<=", 9, "Typical air (PM2.5 {pm})"),
         ("<=", 12, "Somewhat polluted air (PM2.5 {pm})")], "Polluted air (PM2.5 {pm})")
RADON = ([("<", 40, None)], "radon: test any home")
AGE = ([("<", 35, "Young"), ("<=", 45, None)], "Older")
OWNERS = ([("<", 40, "mostly renters"), ("<=", 75, None)], "mostly owners")
APARTMENTS, HOUSES = ([("<", 40, None)], "mostly apartments"), ([("<", 75, None)], "mostly houses")
DOWNTOWN = ([("<=", 3, "Close to downtown"), ("<=", 12, "{miles} mi to downtown")], "Far from a downtown")
COMMUTE = ([("<=", 20, "short commute"), ("<", 35, None)], "long commute")
PRICES = ([("<=", -0.5, "Prices down {size}% in a year ({usual})"), ("<", 0.5, "Prices flat this year ({usual})")],
          "Prices up {size}% in a year ({usual})")
YEARS_OF_RENT = ([("<", 15, "Buying is cheap next to renting · a home costs {years} years of rent"),
                  ("<=", 20, "Buying and renting are about even · a home costs {years} years of rent")],
                 "Renting is cheap next to buying · a home costs {years} years of rent")
METRO = ([("<", 1, "In the {city} metro"), ("<=", 15, "Next to the {city} metro · {miles} mi from its edge"), ("<=", 60, "{miles} mi from the {city} metro")],
         "Far from big metros · {miles} mi to {city}")
OVERALL = {"none": "No hazard data", "worst": "Highest: {worst}{rating}", "but": "{overall} loss rate overall — but {worst}{rating}",
           "overall": "{overall} loss rate overall{rating}"}
STANDING = {"unranked": "{nth} percentile of {all} · {aim}", "top": "as {extreme} as any of the {all}",
            "tied": "{side} than or tied with {points}% of {all}", "over": "{side} than {beats}% of {all}"}
# direction, what is aimed at, the far end, the better side
DIRECTIONS = [("lower", "lower is better", "low", "lower"), ("higher", "higher is better", "high", "higher"), ("middle", "typical is best", "high", "higher")]
ENDINGS = {1: "st", 2: "nd", 3: "rd"}
TYPICAL_VIOLENT_RATE = 248.0
TYPICAL_YEARLY_CHANGE = 1.6
OUTSTANDING_HAZARD, MODERATE_HAZARD = 80, 60
FULL_POINTS, FULL_BEATS, TIE = 99.95, 99.5, 1
HYPHENATED_CITIES = ["Winston-Salem", "Wilkes-Barre"]


def schools(p: Column | str) -> Column:
    return bands.band(p, SCHOOLS, "No test scores for this district")


def safety(violent: Column | str, note: Column | str, typical: float = TYPICAL_VIOLENT_RATE) -> Column:
    missing = F.when(F.length(col(note)) > 0, "Too little reported to rate").otherwise("No crime data")
    return bands.band(col(violent) / typical, SAFETY, missing)


def diversity(index: Column | str, shares: list[tuple[str, Column | str]]) -> Column:
    largest = bands.foremost(shares)
    tail = bands.filled(" · largest group {group} ({share}%)", {"group": largest["label"], "share": bands.whole(largest["value"])})
    return F.coalesce(F.concat(bands.band(index, DIVERSITY), F.coalesce(tail, F.lit(""))), F.lit("No data on who lives here"))


def people(age: Column | str, owners: Column | str, highrise: Column | str, single: Column | str) -> Column:
    homes = F.coalesce(bands.band(highrise, APARTMENTS), bands.band(single, HOUSES))
    return bands.joined([bands.band(age, AGE), bands.band(owners, OWNERS), homes], ", ", "A mix of ages, owners and renters")


def around(downtown: Column | str, commute: Column | str) -> Column:
    where = bands.band(downtown, DOWNTOWN, None, {"miles": bands.whole(downtown)})
    return bands.joined([where, bands.band(commute, COMMUTE)], ", ", "Distances below")


def prices(change: Column | str, typical: float = TYPICAL_YEARLY_CHANGE) -> Column:
    usual = f"typical {'+' if typical >= 0 else '−'}{abs(typical)}%"
    return bands.band(change, PRICES, "No recent price data", {"size": bands.fixed1(F.abs(col(change))), "usual": F.lit(usual)})


def hazards(overall: Column | str, each: list[tuple[str, Column | str]], rating: Column | str) -> Column:
    """Overall word, the worst single hazard where it stands out, and the agency's own rating."""
    worst, o = bands.foremost(each), col(overall)
    stands_out = (worst["value"] >= OUTSTANDING_HAZARD) & (o < MODERATE_HAZARD)
    case = F.when(o.isNotNull(), F.when(stands_out, "but").otherwise("overall")).otherwise(F.when(worst["value"].isNotNull(), "worst").otherwise("none"))
    agency = F.when(F.length(col(rating)) > 0, F.concat(F.lit(" · FEMA: "), col(rating))).otherwise("")
    return bands.by_case(case, OVERALL, {"overall": bands.band(o, HAZARD), "worst": F.lower(worst["label"]), "rating": agency})


def buy_or_rent(price_to_rent: Column | str) -> Column:
    return bands.band(half_up_floor(price_to_rent), YEARS_OF_RENT, "No housing data", {"years": bands.whole(price_to_rent)})


def location(miles: Column | str, metro: Column | str) -> Column:
    city = F.coalesce(bands.metro_city(metro, HYPHENATED_CITIES), F.lit("a big metro"))
    return bands.band(miles, METRO, "Distances below", {"miles": bands.whole(miles), "city": city})


def pollution(pm25: Column | str, doubted: Column | str, smoke: Column | str, radon: Column | str) -> Column:
    pm = {"pm": bands.fixed1(pm25)}
    air = F.when(F.coalesce(col(doubted), F.lit(False)), bands.filled("Air quality uncertain (model PM2.5 {pm})", pm)).otherwise(bands.band(pm25, PM25, None, pm))
    days = bands.filled("{days} smoke days a year", {"days": bands.whole(smoke)})
    return bands.joined([air, days, bands.band(radon, RADON)], " · ", "No pollution data")


def standing(level: Column | str, direction: Column | str, points: Column | str, beats: Column | str, percentile: Column | str) -> Column:
    """Where a value stands, from its points, what it beats and its percentile."""
    d = col(direction)
    aim, extreme, side = (F.element_at(F.create_map(*[x for r in DIRECTIONS for x in (F.lit(r[0]), F.lit(r[i]))]), d) for i in (1, 2, 3))
    parts = {"all": F.when(col(level) == "county", "US counties").otherwise("US areas"), "aim": aim, "extreme": extreme, "side": side,
             "nth": bands.ordinal(F.coalesce(col(percentile), F.lit(0.0)), ENDINGS, "th"), "points": bands.whole(points), "beats": bands.whole(beats)}
    return bands.by_case(bands.standing_case(d, points, beats, (FULL_POINTS, FULL_BEATS), TIE), STANDING, parts)
