"""Which places a search may show: must-haves of many searches over many places, without pairing all with all.

An index of the places by value: each numeric measure is cut into ``CELLS`` cells at about equal shares of the places, each of
these evenly into parts (about the root of the places of a cell), each category into its values; unknown values lie in a cell of
their own, because they neither pass nor fail. A must-have is an interval: whole cells, and parts of the cells at its two ends.
Each search is led by whichever of its must-haves has the fewest places in its interval (counted from the
index); those places alone are met, by an equality of cells, and tested against all of the search's must-haves. Work follows
the places that pass the narrowest must-have of each search. Cells that hold many places are met in pieces.

Where the cuts lie changes the work, never the result: the test is exact.

Counts and the best few of each search need no pairs (``Asked``). Values and bounds are ranked together, so a must-have is a run of ranks.
Ranks lie in nested cells, ``FAN`` in each larger one; a run is a few whole cells of each size, a search few combinations of them over its
must-haves. Places are counted, or the best of them kept, per combination of their own cells: per place and search work follows the
product of the logarithms of its measures, whatever number of places a search shows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import points as P
from ..session import broadcast_checked, durable
from . import rank

CELLS = 64
PIECE_ROWS = 20_000
UNKNOWN_CELL, ALL = "?", "*"
FAN_BITS = 2                    # ranks in nested cells: 4 in each larger one
MEASURES_NESTED, CATEGORIES_NESTED = 3, 2    # searches with must-haves on more columns meet their places
UNKNOWN_RANK = -1
LATER = 2 ** 56                 # put before a position: unknown comes after every match
NUMBERS = ("double", "float", "integer", "long", "short", "byte")
NAMES = "array<string>"


def limit_state(value: Column | str, low: Column | str, high: Column | str) -> Column:
    """``pass``, ``fail`` or ``unknown`` against inclusive bounds; a NULL bound is open."""
    v, lo, hi = (F.col(c) if isinstance(c, str) else c for c in (value, low, high))
    fails = F.coalesce(v < lo, F.lit(False)) | F.coalesce(v > hi, F.lit(False))
    return F.when(v.isNull(), "unknown").when(fails, "fail").otherwise("pass")


def accept_state(value: Column | str, alternative: Column | str, accept: Column | str) -> Column:
    """A category against an accept list; the alternative value is accepted too, an empty list
    accepts nothing."""
    v, alt, ok = (F.col(c) if isinstance(c, str) else c for c in (value, alternative, accept))
    passes = F.array_contains(ok, v) | F.coalesce(F.array_contains(ok, alt), F.lit(False))
    return F.when(v.isNull(), "unknown").when(passes, "pass").otherwise("fail")


def numbers(places: DataFrame, key: str) -> list[str]:
    return [f.name for f in places.schema if f.name != key and f.dataType.typeName() in NUMBERS]


def categories(places: DataFrame, key: str) -> list[str]:
    return [f.name for f in places.schema if f.name != key and f.dataType.typeName() == "string"]


def packed(searches: DataFrame, limits: DataFrame | None, accepts: DataFrame | None) -> DataFrame:
    """One row per search with its must-haves, ``_limits`` and ``_accepts``; a search is what a person asked for, a few rows."""
    out = searches.select("search").distinct()
    for rows, fields, name in ((limits, ("metric", "min", "max"), "_limits"), (accepts, ("category", "accept"), "_accepts")):
        if rows is not None:
            out = out.join(rows.groupBy("search").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)), "search", "left")
    return out


def tested(rows: DataFrame, key: str, measures: Sequence[str], texts: Sequence[str], alternatives: Mapping[str, str]) -> DataFrame:
    """(search, place) with ``failed`` and ``unknown`` from rows that hold a place's values and a search's must-haves."""
    state = "array<struct<name:string,state:string>>"
    states = [F.array().cast(state)]
    if "_limits" in rows.columns:
        value = F.create_map(*[x for m in measures for x in (F.lit(m), F.col(m).cast("double"))])
        states.append(F.coalesce(F.transform("_limits", lambda x: F.struct(
            x["metric"].alias("name"), limit_state(F.try_element_at(value, x["metric"]), x["min"], x["max"]).alias("state"))), F.array().cast(state)))
    if "_accepts" in rows.columns:
        null = F.lit(None).cast("string")
        value_of = F.create_map(*[x for m in texts for x in (F.lit(m), F.col(m))])
        other_of = F.create_map(*[x for m in texts for x in (F.lit(m), F.col(alternatives[m]) if m in alternatives else null)])
        states.append(F.coalesce(F.transform("_accepts", lambda x: F.struct(x["category"].alias("name"), accept_state(
            F.try_element_at(value_of, x["category"]), F.try_element_at(other_of, x["category"]), x["accept"]).alias("state"))), F.array().cast(state)))
    rows = rows.withColumn("_states", F.concat(*states))
    named = lambda s: F.transform(F.filter("_states", lambda x: x["state"] == s), lambda x: x["name"]).cast(NAMES)
    return rows.select("search", key, named("fail").alias("failed"), named("unknown").alias("unknown"))


@dataclass(frozen=True)
class Cuts:
    """Where a measure is cut: smallest value, ``CELLS`` - 1 or fewer values between, largest; parts of each cell."""

    edges: tuple[float, ...]
    parts: int

    def place(self, value: Column) -> Column:
        """Cell and part of a value, (c, p); the pair grows with the value."""
        edges, inner = (F.expr("array(" + ", ".join(f"double('{x!r}')" for x in e) + ")").cast("array<double>") for e in (self.edges, self.edges[1:-1]))
        cell = F.size(F.filter(inner, lambda e: e < value))
        ends = F.struct(value.alias("v"), cell.alias("c"), F.get(edges, cell).alias("left"), F.get(edges, cell + 1).alias("right"))

        def part(x: Column) -> Column:
            share = F.when(x["right"] > x["left"], (x["v"] - x["left"]) / F.when(x["right"] > x["left"], x["right"] - x["left"])).otherwise(0.0)
            return F.floor(F.least(F.greatest(share * self.parts, F.lit(0.0)), F.lit(self.parts - 1.0))).cast("int")

        return F.transform(F.array(ends), lambda x: F.struct(x["c"].alias("c"), part(x).alias("p")))[0]


def cuts(places: DataFrame, measures: Sequence[str]) -> dict[str, Cuts]:
    """One row to the driver, whatever the places."""
    if not measures:
        return {}
    at = [i / CELLS for i in range(1, CELLS)]
    of = lambda m: F.col(m).cast("double")
    row = places.agg(F.count("*"), *[F.struct(F.min(of(m)), F.percentile_approx(of(m), at, 1000), F.max(of(m))) for m in measures]).first()
    parts = max(1, math.ceil(math.sqrt(row[0] / CELLS)))
    return {m: Cuts((low, *sorted(set(inner)), high), parts) for m, (low, inner, high) in zip(measures, row[1:]) if inner is not None}


def _name(cell: Column, part: Column | None = None) -> Column:
    return cell.cast("string") if part is None else F.concat(cell.cast("string"), F.lit("."), part.cast("string"))


def _run(first: Column, last: Column, name: Callable[[Column], Column]) -> Column:
    """Names of ``first`` to ``last``; none where the run is empty."""
    return F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), name)).otherwise(F.array().cast(NAMES))


def _covering(low: Column, high: Column, of: Cuts) -> Column:
    """Cells and parts between two bounds, a NULL bound being open."""
    last, top = len(of.edges) - 2, of.parts - 1
    pair = lambda c, p: F.struct(F.lit(c).alias("c"), F.lit(p).alias("p"))
    ends = F.struct(F.when(low.isNull(), pair(0, 0)).otherwise(of.place(low)).alias("a"), F.when(high.isNull(), pair(last, top)).otherwise(of.place(high)).alias("b"))

    def names(e: Column) -> Column:
        # a cell that is covered to its end counts as whole
        whole_first, whole_last = e["a"]["p"] == 0, e["b"]["p"] == top
        same = F.when(whole_first & whole_last, F.array(_name(e["a"]["c"]))).otherwise(_run(e["a"]["p"], e["b"]["p"], lambda p: _name(e["a"]["c"], p)))
        first = F.when(whole_first, F.array(_name(e["a"]["c"]))).otherwise(_run(e["a"]["p"], F.lit(top), lambda p: _name(e["a"]["c"], p)))
        final = F.when(whole_last, F.array(_name(e["b"]["c"]))).otherwise(_run(F.lit(0), e["b"]["p"], lambda p: _name(e["b"]["c"], p)))
        between = F.concat(first, _run(e["a"]["c"] + 1, e["b"]["c"] - 1, lambda c: _name(c)), final)
        return F.when(e["a"]["c"] < e["b"]["c"], between).when(e["a"]["c"] == e["b"]["c"], same).otherwise(F.array().cast(NAMES))

    return F.transform(F.array(ends), names)[0]


def _entries(places: DataFrame, edges: Mapping[str, Cuts], texts: Sequence[str], alternatives: Mapping[str, str]) -> DataFrame:
    """Each place under each of its cells. A category's alternative is a second cell, marked with the place's own one."""
    none = F.lit(None).cast("string")
    entry = lambda name, cell, own=none: F.struct(F.lit(name).alias("name"), cell.alias("cell"), own.alias("own"))
    out, located = [entry(ALL, F.lit(ALL))], places
    for m, of in edges.items():
        v = F.col(m).cast("double")
        at = F.col(f"_at_{m}")
        located = located.withColumn(f"_at_{m}", F.when(v.isNotNull(), of.place(v)))
        out += [entry(m, F.when(v.isNull(), UNKNOWN_CELL).otherwise(_name(at["c"]))), F.when(v.isNotNull(), entry(m, _name(at["c"], at["p"])))]
    for c in texts:
        own = F.concat(F.lit("="), F.col(c))
        out.append(entry(c, F.coalesce(own, F.lit(UNKNOWN_CELL))))
        if c in alternatives:
            other = F.concat(F.lit("="), F.col(alternatives[c]))
            out.append(F.when(F.coalesce(own != other, F.lit(False)), entry(c, other, own)))
    return located.withColumn("_e", F.explode(F.array_compact(F.array(*out)))).select(*places.columns, "_e.*")


def _intervals(searches: DataFrame, limits: DataFrame | None, accepts: DataFrame | None, edges: Mapping[str, Cuts], texts: Sequence[str]) -> DataFrame:
    """(search, name, cells): the cells that can hold what passes or is unknown, by must-have; for every search also all places."""
    out = searches.select("search", F.lit(ALL).alias("name"), F.array(F.lit(ALL)).alias("cells"))
    if limits is not None and edges:
        inside = F.lit(None).cast(NAMES)
        for m, of in edges.items():
            inside = F.when(F.col("metric") == m, _covering(F.col("min").cast("double"), F.col("max").cast("double"), of)).otherwise(inside)
        known = limits.where(F.col("metric").isin(*edges))
        out = out.unionByName(known.select("search", F.col("metric").alias("name"), F.concat(inside, F.array(F.lit(UNKNOWN_CELL))).alias("cells")))
    if accepts is not None and texts:
        values = F.transform(F.array_compact(F.array_distinct("accept")), lambda v: F.concat(F.lit("="), v))
        known = accepts.where(F.col("category").isin(*texts))
        out = out.unionByName(known.select("search", F.col("category").alias("name"), F.concat(values, F.array(F.lit(UNKNOWN_CELL))).alias("cells")))
    return out


def _met(places: DataFrame, key: str, searches: DataFrame, limits: DataFrame | None, accepts: DataFrame | None, alternatives: Mapping[str, str]) -> DataFrame:
    """Places, each with the searches whose narrowest must-have may let it through, and their must-haves. No pair comes twice."""
    measures = numbers(places, key) if limits is not None else []
    used = [c for c in categories(places, key) if c not in alternatives.values()] if accepts is not None else []
    edges = cuts(places, measures)
    entries = _entries(places, edges, used, alternatives)
    counts = durable(entries.groupBy("name", "cell").agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / PIECE_ROWS)))

    # the must-have with the fewest places leads
    wanted = packed(searches, limits, accepts)
    choices = _intervals(wanted, limits, accepts, edges, used).withColumn("cell", F.explode("cells"))
    choices = choices.join(broadcast_checked(counts.select("name", "cell", "n")), ["name", "cell"], "left").groupBy("search", "name", "cells")
    choices = choices.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).groupBy("search").agg(F.min(F.struct("n", "name", "cells")).alias("_lead"))
    leads = wanted.join(choices, "search").select(*wanted.columns, "_lead.name", "_lead.cells")
    leads = leads.withColumn("cell", F.explode("cells")).join(broadcast_checked(counts.select("name", "cell", "pieces")), ["name", "cell"])
    leads = leads.withColumn("cells", F.when(F.col("name").isin(*used), F.col("cells")))
    leads = durable(leads.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces"))

    cut = counts.where("pieces > 1").select("name", "cell", "pieces")
    pieces = entries.join(broadcast_checked(cut), ["name", "cell"], "left")
    pieces = pieces.withColumn("piece", F.pmod(F.xxhash64(key), F.coalesce("pieces", F.lit(1)).cast("long"))).drop("pieces")
    pairs = pieces.join(broadcast_checked(leads), ["name", "cell", "piece"])
    return pairs.where(~F.coalesce(F.array_contains("cells", F.col("own")), F.lit(False)))    # met under its own value


def shown_places(places: DataFrame, key: str, searches: DataFrame, limits: DataFrame | None = None, accepts: DataFrame | None = None,
                 alternatives: Mapping[str, str] | None = None) -> DataFrame:
    """(search, place, ``status``, ``unknown``) of every place that a search does not exclude: 0 matches, 1 is unknown.

    A must-have on what is no column of ``places`` is unknown everywhere. ``places`` is read three times: make it durable if it is dear.
    """
    pairs = _met(places, key, searches, limits, accepts, alternatives or {})
    found = tested(pairs, key, numbers(places, key), categories(places, key), alternatives or {}).where(F.size("failed") == 0)
    return found.select("search", key, F.when(F.size("unknown") > 0, 1).otherwise(0).alias("status"), "unknown")


def shown_counts(shown: DataFrame | Asked, searches: DataFrame, places: DataFrame) -> DataFrame:
    """How many places of each search match, are unknown and are excluded: from the places that aren't, or without pairs from what is asked."""
    total = places.count()
    if isinstance(shown, Asked):
        of = _counted(shown)
    else:
        of = shown.groupBy("search").agg(F.count_if(F.col("status") == 0).alias("match"), F.count_if(F.col("status") == 1).alias("unknown"))
    out = searches.select("search").distinct().join(of, "search", "left").na.fill(0, ["match", "unknown"])
    return out.withColumn("excluded", F.lit(total) - F.col("match") - F.col("unknown"))


def shown_scores(shown: DataFrame, key: str, ranked: DataFrame, criteria: DataFrame) -> DataFrame:
    """``shown`` with ``score``: Σ(weight × points) / Σ(weight), unknown values at 50 points; NULL where nothing is weighted.

    ``ranked``: (place, metric, lo, hi, mid) as of ``rank.rank_rows``, turned into one row per place. Work follows the pairs that are shown.
    """
    held = ranked.where(F.col("metric").isNotNull()).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.struct("lo", "hi", "mid")))).alias("_held"))
    asked = criteria.withColumn("weight", P.clamp_weight("weight")).where("weight > 0")
    asked = asked.groupBy("search").agg(F.array_sort(F.collect_list(F.struct("metric", "weight", "direction"))).alias("_asked"))
    rows = shown.join(asked, "search", "left").join(held, key, "left")

    def points(a: Column) -> Column:
        of = F.try_element_at("_held", a["metric"])
        return F.coalesce(P.directional(of["lo"], of["hi"], of["mid"], a["direction"]), F.lit(P.AVERAGE_POINTS))

    total = F.aggregate("_asked", F.lit(0.0), lambda s, a: s + a["weight"])
    part = F.aggregate("_asked", F.lit(0.0), lambda s, a: s + a["weight"] * points(a))
    return rows.withColumn("score", F.when(total > 0, part / total)).drop("_asked", "_held")


# --- counts and the best few, without pairs ----------------------------------


@dataclass(frozen=True)
class Asked:
    """What ``shown_places`` is given, to be counted (``shown_counts``) or cut to the best (``best_places``)."""

    places: DataFrame
    key: str
    searches: DataFrame
    limits: DataFrame | None = None
    accepts: DataFrame | None = None
    alternatives: Mapping[str, str] | None = None

    def of(self, searches: DataFrame) -> DataFrame:
        """The same for some of the searches, as pairs."""
        return shown_places(self.places, self.key, searches, self.limits, self.accepts, self.alternatives)


@dataclass(frozen=True)
class Nested:
    """Searches with must-haves on the same columns (``boxes``), and the places (``_row``, ranks and categories) to be found for them."""

    boxes: DataFrame
    places: DataFrame
    levels: dict[str, int]
    texts: list[str]
    alternatives: Mapping[str, str]

    @property
    def cells(self) -> list[str]:
        return [*(f"_x_{m}" for m in self.levels), *(f"_k_{c}" for c in self.texts)]

    @property
    def own(self) -> list[str]:
        return [f"_own_{c}" for c in self.texts]

    def entries(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` of places under each combination of their cells; a category's alternative is a second cell, marked with the own one."""
        for m, top in self.levels.items():
            at = F.col(f"_r_{m}")
            cells = F.array(*[_nested(F.shiftright(at, FAN_BITS * n), n) for n in range(top + 1)])
            rows = rows.withColumn(f"_x_{m}", F.explode(F.when(at.isNull(), F.array(F.lit(UNKNOWN_RANK).cast("long"))).otherwise(cells)))
        for c in self.texts:
            own, none = F.concat(F.lit("="), F.col(c)), F.lit(None).cast("string")
            entry = [F.struct(F.coalesce(own, F.lit(UNKNOWN_CELL)).alias("k"), none.alias("own"))]
            if c in self.alternatives:
                other = F.concat(F.lit("="), F.col(self.alternatives[c]))
                entry.append(F.when(F.coalesce(own != other, F.lit(False)), F.struct(other.alias("k"), own.alias("own"))))
            rows = rows.withColumn("_e", F.explode(F.array_compact(F.array(*entry))))
            rows = rows.withColumns({f"_k_{c}": F.col("_e.k"), f"_own_{c}": F.col("_e.own")}).drop("_e")
        return rows.select(*self.cells, *self.own, *columns)

    def lookups(self, *columns: str) -> DataFrame:
        """The combinations of cells that hold what each search shows, none twice, with the ``_status`` of what is in them."""
        rows = self.boxes
        for m, top in self.levels.items():
            whole = _cover(F.col(f"_lo_{m}"), F.col(f"_hi_{m}"), top)
            rows = rows.withColumn(f"_x_{m}", F.explode(F.concat(whole, F.array(F.lit(UNKNOWN_RANK).cast("long")))))
        for c in self.texts:
            named = F.transform(f"_ok_{c}", lambda v: F.concat(F.lit("="), v))
            rows = rows.withColumn(f"_ok_{c}", named).withColumn(f"_k_{c}", F.explode(F.concat(F.col(f"_ok_{c}"), F.array(F.lit(UNKNOWN_CELL)))))
        unknown = F.col("_odd")
        for c in self.cells:
            unknown = unknown | (F.col(c) == (UNKNOWN_CELL if c.startswith("_k_") else UNKNOWN_RANK))
        return rows.select("search", *columns, *self.cells, *[f"_ok_{c}" for c in self.texts if c in self.alternatives], F.when(unknown, 1).otherwise(0).alias("_status"))

    def found(self, held: DataFrame, *columns: str) -> DataFrame:
        """``lookups`` beside what is held in their cells. The planner can't foresee how many rows either side is unfolded to."""
        on, held = [*self.cells, *columns], durable(held)
        few = broadcast_checked(held)
        held = few if few is not held else held.hint("merge")
        pairs = self.lookups(*columns).join(held, on) if on else self.lookups().crossJoin(held)
        for c in (c for c in self.texts if c in self.alternatives):      # met under its own value
            pairs = pairs.filter(~F.coalesce(F.array_contains(f"_ok_{c}", F.col(f"_own_{c}")), F.lit(False)))
        return pairs


def _nested(cell: Column, level: int) -> Column:
    """One number for a cell and its size."""
    return cell * 64 + level


def _cover(low: Column, high: Column, top: int) -> Column:
    """The fewest whole cells that make up the ranks from ``low`` up to, not including, ``high``."""
    run = lambda a, b: F.when(a < b, F.sequence(a, F.greatest(a, b - 1))).otherwise(F.array().cast("array<long>"))
    first = lambda n: F.shiftright(low + ((1 << FAN_BITS * n) - 1), FAN_BITS * n)
    last = lambda n: F.shiftright(high, FAN_BITS * n)

    def cells_of(n: int) -> Column:
        a, b, up, down = first(n), last(n), F.shiftleft(first(n + 1), FAN_BITS), F.shiftleft(last(n + 1), FAN_BITS)
        cells = F.when(up < down, F.concat(run(a, up), run(down, b))).otherwise(run(a, b)) if n < top else run(a, b)
        return F.transform(cells, lambda i: _nested(i, n))

    return F.concat(*[cells_of(n) for n in range(top + 1)])


def _asked_boxes(asked: Asked, measures: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """One row per search: ``_low_`` and ``_high_`` of each measure, the accepted values of each category, which of them are asked
    (``_measures``, ``_texts``), ``_odd`` where something else is asked, which is unknown everywhere, and ``_apart`` where pairs must be met."""
    out = asked.searches.select("search").where("search IS NOT NULL").distinct()
    odd, names = [F.lit(False)], {"_measures": [], "_texts": []}
    if asked.limits is not None:
        of = lambda m, c: F.when(F.col("metric") == m, F.col(c).cast("double"))
        out = out.join(asked.limits.groupBy("search").agg(
            F.count_if(~F.coalesce(F.col("metric").isin(*measures), F.lit(False))).alias("_odd_m"),
            *[f(of(m, c)).alias(f"{n}_{m}") for m in measures for f, c, n in ((F.max, "min", "_low"), (F.min, "max", "_high"))],
            *[F.count_if(F.col("metric") == m).alias(f"_n_{m}") for m in measures]), "search", "left")
        odd.append(F.coalesce(F.col("_odd_m") > 0, F.lit(False)))
        names["_measures"] = [F.when(F.col(f"_n_{m}") > 0, m) for m in measures]
    if asked.accepts is not None:
        values = F.sort_array(F.array_distinct(F.array_compact(F.coalesce("accept", F.array().cast(NAMES)))))
        out = out.join(asked.accepts.groupBy("search").agg(
            F.count_if(~F.coalesce(F.col("category").isin(*texts), F.lit(False))).alias("_odd_c"),
            *[F.collect_set(F.when(F.col("category") == c, values)).alias(f"_lists_{c}") for c in texts]), "search", "left")
        odd.append(F.coalesce(F.col("_odd_c") > 0, F.lit(False)))
        out = out.withColumns({f"_ok_{c}": F.get(f"_lists_{c}", F.lit(0)) for c in texts})
        names["_texts"] = [F.when(F.size(f"_lists_{c}") > 0, c) for c in texts]
    out = out.withColumns({n: F.array_compact(F.array(*of)) if of else F.array().cast(NAMES) for n, of in names.items()})
    apart = (F.size("_measures") > MEASURES_NESTED) | (F.size("_texts") > CATEGORIES_NESTED)
    for c in texts if asked.accepts is not None else []:
        apart = apart | F.coalesce(F.size(f"_lists_{c}") > 1, F.lit(False))
    return out.withColumns({"_odd": functools.reduce(Column.__or__, odd), "_apart": apart})


def _nests(asked: Asked, columns: DataFrame | None = None) -> tuple[list[Nested], DataFrame, DataFrame]:
    """The searches by the columns that they ask for; those whose pairs must be met; and the places with their ``_row``.

    ``columns``: more columns by search, which the boxes keep.
    """
    places = durable(asked.places.withColumn("_row", F.monotonically_increasing_id()))
    measures = numbers(asked.places, asked.key) if asked.limits is not None else []
    texts = categories(asked.places, asked.key) if asked.accepts is not None else []
    boxes = _asked_boxes(asked, measures, texts)
    boxes = durable(boxes if columns is None else boxes.join(columns, "search", "left"))
    groups = boxes.where("NOT _apart").select("_measures", "_texts").distinct().collect()    # at most one per set of columns

    # bounds are ranked among the values, each of them once
    used = [m for m in measures if any(m in g["_measures"] for g in groups)]
    near, ranked, sizes = boxes.where("NOT _apart"), places, {}
    if used:
        ends = functools.reduce(DataFrame.unionByName, [
            rank.unpivot(near.select(F.lit(0).alias("_"), *[F.col(f"{end}_{m}").alias(m) for m in used]), ["_"], used) for end in ("_low", "_high")])
        values = rank.unpivot(places.select(F.lit(0).alias("_"), *used), ["_"], used).unionByName(ends).select("metric", "value").distinct()
        ranks = durable(rank.value_ranks(values, ["metric"]))
        sizes = {r["metric"]: r["n"] for r in ranks.groupBy("metric").agg(F.max("n").alias("n")).collect()}    # one per column
        of = lambda m, name: ranks.where(F.col("metric") == m).select(F.col("value").alias("_v"), F.col("below").alias(name))
        for m in used:
            ranked = ranked.join(of(m, f"_r_{m}"), F.col(m).cast("double") == F.col("_v"), "left").drop("_v")
            near = near.join(of(m, f"_lo_{m}"), F.col(f"_low_{m}") == F.col("_v"), "left").drop("_v")
            near = near.join(of(m, f"_hi_{m}"), F.col(f"_high_{m}") == F.col("_v"), "left").drop("_v")
        ranked = durable(ranked.select("_row", *[f"_r_{m}" for m in used], *texts))
    levels = {m: -(-(sizes.get(m, 1) - 1).bit_length() // FAN_BITS) for m in used}
    for m in used:
        # up to the last value is up to the end of the largest cell
        after = F.when(F.coalesce(F.col(f"_hi_{m}") + 1 < sizes.get(m, 1), F.lit(False)), F.col(f"_hi_{m}") + 1).otherwise(F.lit(1 << FAN_BITS * levels[m]))
        near = near.withColumns({f"_lo_{m}": F.coalesce(f"_lo_{m}", F.lit(0)).cast("long"), f"_hi_{m}": after.cast("long")})
    near = durable(near) if used else near

    nests = []
    for g in groups:
        same = functools.reduce(Column.__and__, [F.col(n) == (F.array(*[F.lit(c) for c in g[n]]).cast(NAMES)) for n in ("_measures", "_texts")])
        nests.append(Nested(near.where(same), ranked, {m: levels[m] for m in g["_measures"]}, list(g["_texts"]), asked.alternatives or {}))
    return nests, boxes.where("_apart").select("search"), places


def _counted(asked: Asked) -> DataFrame:
    """(search, match, unknown) of searches that show something."""
    nests, apart, _ = _nests(asked)
    parts = [asked.of(apart).select("search", F.col("status").alias("_status"), F.lit(1).cast("long").alias("_c"))] if not apart.isEmpty() else []
    for n in nests:
        used = [*(f"_r_{m}" for m in n.levels), *dict.fromkeys(c for t in n.texts for c in (t, n.alternatives.get(t)) if c)]
        alike = n.places.groupBy(*used).agg(F.count("*").alias("_c"))
        held = n.entries(alike, "_c").groupBy(*n.cells, *n.own).agg(F.sum("_c").alias("_c"))
        parts.append(n.found(held).select("search", "_status", "_c"))
    if not parts:
        return asked.searches.select("search", *[F.lit(0).cast("long").alias(c) for c in ("match", "unknown")]).limit(0)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("_status") == k, F.col("_c"))), F.lit(0)).cast("long")
    return functools.reduce(DataFrame.unionByName, parts).groupBy("search").agg(of(0).alias("match"), of(1).alias("unknown"))


def best_places(asked: Asked, ranked: DataFrame, criteria: DataFrame, n: int, shown_as: Callable[[Column], Column] = lambda score: score) -> DataFrame:
    """(search, place, ``status``, ``unknown``) of the places among which a search's ``n`` best are: by status, score and key.

    Scores are those of ``shown_scores``, compared as ``shown_as`` gives them. Every place is scored once for each list of criteria, so
    searches that weigh alike share the work; with a list for each search it is as much as pairs.
    """
    weighed = criteria.withColumn("weight", P.clamp_weight("weight")).where("weight > 0").groupBy("search").agg(
        F.array_sort(F.collect_list(F.struct("metric", "weight", "direction"))).alias("_asked"))
    weighed = durable(asked.searches.select("search").where("search IS NOT NULL").distinct().join(weighed, "search", "left"))
    lists = durable(weighed.groupBy("_asked").agg(F.min("search").alias("_like")))
    nests, apart, places = _nests(asked, weighed.join(lists, weighed["_asked"].eqNullSafe(lists["_asked"])).select("search", "_like"))

    each = places.select("_row", asked.key).crossJoin(broadcast_checked(lists.select(F.col("_like").alias("search"))))
    scored = shown_scores(each, asked.key, ranked, criteria.join(lists.select(F.col("_like").alias("search")), "search", "left_semi"))
    score = shown_as(F.col("score"))
    scored = scored.select(F.col("search").alias("_like"), F.struct(score.isNull().alias("none"), (-score).alias("last"), F.col(asked.key).alias("key"), "_row").alias("_o"))
    order = durable(rank.value_ranks(scored, ["_like"], "_o").select("_like", F.col("_o._row").alias("_row"), F.col("below").alias("_at")))

    first = [F.asc("_at")]
    parts = [asked.of(apart).select("search", asked.key, "status", "unknown")] if not apart.isEmpty() else []
    for nest in nests:
        # a cell's best n hold what of it is among any search's best n
        held = rank.top_k(nest.entries(nest.places.join(order, "_row"), "_like", "_row", "_at"), [*nest.cells, *nest.own, "_like"], first, n, "_n").drop("_n")
        hits = nest.found(held, "_like").select("search", "_row", (F.col("_status") * F.lit(LATER) + F.col("_at")).alias("_at"))
        best = rank.top_k(hits, ["search"], first, n, "_n").select("search", "_row")
        pairs = best.join(places, "_row").drop("_row").join(packed(asked.searches, asked.limits, asked.accepts), "search")
        sure = tested(pairs, asked.key, numbers(asked.places, asked.key), categories(asked.places, asked.key), asked.alternatives or {}).where(F.size("failed") == 0)
        parts.append(sure.select("search", asked.key, F.when(F.size("unknown") > 0, 1).otherwise(0).alias("status"), "unknown"))
    return functools.reduce(DataFrame.unionByName, parts) if parts else asked.of(asked.searches)
