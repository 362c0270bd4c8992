"""Looking places up by name: an index of counties, cities, neighborhoods and ZIPs read off area labels,
and ranked matches for typed queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_place, parse_label
from . import rank
from .facts import STATES

# Fixed value: the words after a county's name.
COUNTY_WORDS = r" (county|parish|borough|census area|municipality|city and borough|city)$"
MATCH_LIMIT = 8
# Fixed value: New York City's boroughs are counties under other names.
COUNTY_ALSO = {"36047": "Brooklyn", "36061": "Manhattan", "36085": "Staten Island"}


def group_areas(areas: DataFrame, group: Column, population: str = "population") -> DataFrame:
    """Areas grouped by city or community, with their number and people."""
    return areas.groupBy(group.alias("group")).agg(F.count("*").alias("areas"), F.sum(F.coalesce(population, F.lit(0))).alias("population"))


def _named(value: Column, names: Mapping[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def place_index(areas: DataFrame, counties: DataFrame, label: str = "label") -> DataFrame:
    """One row per place: kind, name, where, population, bounds, the county most of its people are in,
    its normalized name and the words that may follow it.

    ``areas``: area, county, label, population, lat, lon. ``counties``: county, county_name, state,
    population, and if they are there ``state_name`` and ``also``, the county's other name; else these are the
    states' full names and New York City's boroughs. A city no area sits inside is made of the areas beside it. Dominant county and city come
    from nested sums, so a city holding a third of all areas still shuffles a row per county and task.
    """
    if "state_name" not in counties.columns:
        counties = counties.withColumn("state_name", _named(F.col("state"), {code: name for code, name, _ in STATES}))
    if "also" not in counties.columns:
        counties = counties.withColumn("also", _named(F.lpad(F.col("county").cast("string"), 5, "0"), COUNTY_ALSO))
    parsed = areas.join(counties.select("county", "state"), "county").withColumn("_p", parse_label(label)).select(
        "area", "county", "state", "population", "lat", "lon", "_p.*")
    kinds = F.array(
        F.when(F.col("city").isNotNull(), F.struct(F.lit("city").alias("kind"), F.col("city").alias("name"), F.col("state").alias("st"),
                                                   F.lit(None).cast("string").alias("in_city"), F.col("near").alias("beside"))),
        F.when(F.col("city").isNotNull() & F.col("neighborhood").isNotNull(), F.struct(
            F.lit("neighborhood").alias("kind"), F.col("neighborhood").alias("name"), F.col("state").alias("st"), F.col("city").alias("in_city"),
            F.lit(False).alias("beside"))),
        F.when(F.col("zip").isNotNull(), F.struct(F.lit("zip").alias("kind"), F.col("zip").alias("name"), F.lit("").alias("st"),
                                                  F.lit(None).cast("string").alias("in_city"), F.lit(False).alias("beside"))))
    people = F.coalesce(F.col("population").cast("double"), F.lit(0.0))
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    rows = parsed.withColumn("_k", F.explode(F.array_compact(kinds))).select(
        "_k.*", "county", "city", people.alias("people"), F.when(located, F.col("lat")).alias("lat"), F.when(located, F.col("lon")).alias("lon"))
    rows = rows.withColumn("_id", F.concat_ws("|", "kind", "name", F.coalesce("in_city", F.lit("")), "st"))
    cells = rows.groupBy("_id", "kind", "name", "in_city", "st", "beside", "county", "city").agg(
        F.count("*").alias("areas"), F.sum("people").alias("people"), F.sum(F.col("people") + 1).alias("w"), F.min("lat").alias("south"),
        F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    # Areas inside a place win over those beside it.
    sides = cells.groupBy("_id").agg(F.min("beside").alias("near"))
    cells = cells.join(sides, "_id").filter(F.col("beside") == F.col("near"))
    by_county = cells.groupBy("_id", "county").agg(F.sum("w").alias("w")).groupBy("_id").agg(
        F.min(F.struct((-F.col("w")).alias("w"), F.col("county").alias("c")))["c"].alias("_c"), F.count("*").alias("_counties"))
    by_city = cells.filter((F.col("kind") == "zip") & F.col("city").isNotNull()).groupBy("_id", "city").agg(F.sum("w").alias("w")).groupBy("_id").agg(
        F.max_by("city", F.struct("w", "city")).alias("_zip_city"))
    whole = cells.groupBy("_id", "kind", "name", "in_city", "st", "near").agg(
        F.sum("areas").alias("areas"), F.sum("people").alias("population"), F.min("south").alias("south"), F.max("north").alias("north"),
        F.min("west").alias("west"), F.max("east").alias("east"))
    out = whole.join(by_county, "_id").join(by_city, "_id", "left").withColumn("county", F.col("_c"))
    names = counties.select("county", F.col("county_name").alias("_county"), F.col("state").alias("_state"), F.col("state_name").alias("_state_name"))
    out = out.join(names, "county", "left")
    state = F.when(F.col("st") != "", F.col("st")).otherwise(F.coalesce("_state", F.lit("")))
    city = F.when(F.col("kind") == "zip", F.col("_zip_city")).otherwise(F.col("in_city"))
    more = F.when(F.col("_counties") > 1, F.concat(F.lit(" + "), (F.col("_counties") - 1).cast("string"), F.lit(" more"))).otherwise("")
    where = (F.when(F.col("kind") == "city", F.concat(F.coalesce("_county", F.lit("")), more, F.lit(", "), state))
             .when(city.isNotNull(), F.concat(city, F.lit(", "), state)).otherwise(state))
    norm = normalize_place("name")
    context = F.filter(F.split(F.concat_ws(" ", normalize_place(F.coalesce(city, F.lit(""))), normalize_place(state), normalize_place("_state_name")), " "), lambda w: w != "")
    mine = out.select("kind", "name", where.alias("where"), state.alias("state"), "county", "near", "areas", "population", "south", "north",
                      "west", "east", norm.alias("norm"), F.lit(None).cast("string").alias("short"), context.alias("context"))
    cnorm = normalize_place("county_name")
    theirs = counties.select(
        F.lit("county").alias("kind"), F.col("county_name").alias("name"), F.col("state").alias("where"), "state", "county", F.lit(False).alias("near"),
        F.lit(0).cast("long").alias("areas"), F.coalesce(F.col("population").cast("double"), F.lit(0.0)).alias("population"),
        *[F.lit(None).cast("double").alias(c) for c in ("south", "north", "west", "east")], cnorm.alias("norm"),
        F.regexp_replace(cnorm, COUNTY_WORDS, "").alias("short"), F.split(F.concat_ws(" ", normalize_place("state"), normalize_place("state_name")), " ").alias("context"), F.col("also").alias("_also"))
    others = theirs.filter(F.col("_also").isNotNull()).withColumns({
        "name": F.col("_also"), "where": F.concat_ws(", ", "name", "state"), "norm": normalize_place("_also"), "short": F.lit(None).cast("string")})
    return theirs.unionByName(others).drop("_also").unionByName(mine)


def _starts_word(text: Column, token: Column) -> Column:
    return F.startswith(text, token) | F.contains(text, F.concat(F.lit(" "), token))


def match_quality(norm: Column, short: Column, context: Column, tokens: Column) -> Column:
    """3 the name is the query, 2 it starts with it, 1 it has its words, 0 no match; words after the name
    must all fit its context. The longest leading run of words that fits decides."""
    def at(k: Column) -> Column:
        head, rest = F.slice(tokens, 1, k), F.slice(tokens, k + 1, F.size(tokens))
        fits = F.forall(rest, lambda t: F.exists(context, lambda c: F.startswith(c, t)))
        name = F.array_join(head, " ")
        quality = (F.when((norm == name) | F.coalesce(short == name, F.lit(False)), 3).when(F.startswith(norm, name), 2)
                   .when(F.forall(head, lambda t: _starts_word(norm, t)), 1).otherwise(0))
        return F.when(fits, quality).otherwise(0)
    lengths = F.sequence(F.size(tokens), F.lit(1), F.lit(-1))
    tries = F.filter(F.transform(lengths, at), lambda q: q > 0)
    return F.when(_starts_word(norm, F.get(tokens, 0)), F.coalesce(F.get(tries, 0), F.lit(0))).otherwise(0)


def search_places(index: DataFrame, queries: DataFrame, limit: int = MATCH_LIMIT) -> DataFrame:
    """The best matches of each query: closest name, then most people, then the name.

    ``queries``: (query_id, text). Index words and the queries' first words meet on their first three letters,
    so a query meets only places with such a word.
    """
    q = queries.withColumn("_n", normalize_place("text")).filter(F.length("_n") >= 2)
    q = q.withColumn("_tokens", F.split("_n", " ")).withColumn("_prefix", F.substring(F.get("_tokens", F.lit(0)), 1, 3))
    starts = lambda w: F.array(*[F.substring(w, 1, n) for n in (1, 2, 3)])
    words = index.withColumn("_prefix", F.explode(F.array_distinct(F.flatten(F.transform(F.split("norm", " "), starts)))))
    hits = words.join(q, "_prefix").withColumn("quality", match_quality(F.col("norm"), F.col("short"), F.col("context"), F.col("_tokens")))
    hits = hits.filter(F.col("quality") > 0).drop("_prefix", "_n", "_tokens")
    return rank.top_k(hits, ["query_id"], [F.desc("quality"), F.desc("population"), F.asc("name"), F.asc("where")], limit)
