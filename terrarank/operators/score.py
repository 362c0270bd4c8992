"""Searches over places: weights, directions, must-haves, and the ranked, explained result.

A search is rows, not an object: ``criteria(search, metric, weight, direction, budget)``,
``limits(search, metric, min, max)`` and ``accepts(search, category, accept)``. Any number of
searches runs in one plan. Criteria and limits are what a person asked for — a handful of rows per
search — and join the long measures on the metric.

Rules: an unknown weighted measure counts 50 points at full weight; an unknown value neither passes
nor fails a must-have; ranks are over every place in scope, so must-haves never change points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import points as P
from ..session import DEFAULT_LIMITS, Limits, broadcast_checked
from . import musthaves, rank
from .musthaves import accept_state, limit_state  # noqa: F401

MATCH, UNKNOWN, EXCLUDED, OUT = 0, 1, 2, 3
BLOCK = 256   # searches met together in a report over all pairs
STATUS_WORDS = {MATCH: "match", UNKNOWN: "unknown", EXCLUDED: "excluded", OUT: "out"}


def status_word(status: Column | str) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    out = F.lit(None).cast("string")
    for code, word in STATUS_WORDS.items():
        out = F.when(status == code, F.lit(word)).otherwise(out)
    return out


def point_columns(direction: str = "direction") -> dict[str, Column]:
    """``points`` and ``beats`` from ``lo``, ``hi``, ``mid`` and a direction."""
    return {"points": P.directional("lo", "hi", "mid", direction), "beats": P.beats("lo", "hi", direction)}


def contributions(places: DataFrame, key: str, criteria: DataFrame, measures: Sequence[str],
                  limits: Limits = DEFAULT_LIMITS, bounds: DataFrame | None = None) -> DataFrame:
    """One row per (search, place, weighted metric): value, percentile, points, impact, beats.

    Ranks are computed once per metric whatever the number of searches; with a durable ``bounds`` table of
    the same places they are not computed at all. Unknown values have no row (see :func:`scores`).
    """
    long = rank.unpivot(places, [key], measures)
    ranked = rank.rank_rows(long, [key], ["metric"], limits=limits, bounds=bounds).drop("n")
    asked = criteria.withColumn("weight", P.clamp_weight("weight")).filter(F.col("weight") > 0)
    known = ranked.join(asked, "metric").withColumns(point_columns())
    known = known.select("search", key, "metric", "value", "direction", F.col("mid").alias("percentile"), "points",
                         "weight", (F.col("weight") * (F.col("points") - 50)).alias("impact"), "beats")
    return known


def scores(places: DataFrame, key: str, criteria: DataFrame, known: DataFrame, statuses: DataFrame) -> DataFrame:
    """Σ(weight × points) / Σ(weight) per (search, place), with the place's status and how many
    weighted measures it has no value for. NULL when excluded or when nothing is weighted.

    ``known`` are the contributions with a value; the missing ones add 50 points through the
    search's total weight, so they need no rows.
    """
    asked = criteria.withColumn("weight", P.clamp_weight("weight")).filter(F.col("weight") > 0)
    totals = asked.groupBy("search").agg(F.sum("weight").alias("_total"), F.count("*").alias("_asked"))
    part = known.groupBy("search", key).agg(
        F.sum(F.col("weight") * F.col("points")).alias("_sum"), F.sum("weight").alias("_weight"),
        F.count("*").alias("_known"))
    joined = statuses.join(totals, "search", "left").join(part, ["search", key], "left")
    known_weight = F.coalesce("_weight", F.lit(0.0))
    total = F.coalesce("_sum", F.lit(0.0)) + P.AVERAGE_POINTS * (F.col("_total") - known_weight)
    score = F.when((F.col("status") != EXCLUDED) & (F.col("_total") > 0), total / F.col("_total"))
    return joined.withColumns({
        "score": score,
        "missing": (F.coalesce("_asked", F.lit(0)) - F.coalesce("_known", F.lit(0))).cast("long"),
    }).drop("_total", "_asked", "_sum", "_weight", "_known")


def status_counts(statuses: DataFrame) -> DataFrame:
    """How many places of each search match, are unknown and are excluded; ``statuses`` as of ``filter_results``."""
    of = lambda k: F.count_if(F.col("status") == k)
    return statuses.groupBy("search").agg(of(0).alias("match"), of(1).alias("unknown"), of(2).alias("excluded"))


def _every_pair(places: DataFrame, searches: DataFrame) -> DataFrame:
    """Each place with each row of ``searches``, for reports over all of both: the searches go in blocks of up to ``BLOCK`` beside the places."""
    columns = [F.col(c) for c in searches.columns]
    blocks = -(-searches.count() // BLOCK)
    block = F.pmod(F.xxhash64("search"), F.lit(max(1, blocks)).cast("long"))
    rows = searches.groupBy(block.alias("_block")).agg(F.collect_list(F.struct(*columns)).alias("_searches"))
    return places.crossJoin(broadcast_checked(rows, 1000)).withColumn("_s", F.explode("_searches")).select(*places.columns, "_s.*")


def filter_results(places: DataFrame, key: str, limits: DataFrame | None = None, accepts: DataFrame | None = None,
                   alternatives: dict[str, str] | None = None) -> DataFrame:
    """One row per (search, place): ``status``, ``failed`` and ``unknown`` filter names.

    A report over all pairs, for a stated set of searches. To show results use ``musthaves.shown_places``, which
    meets only the places that a search's narrowest must-have lets through.
    """
    given = [f.select("search") for f in (limits, accepts) if f is not None]
    searches = musthaves.packed(given[0] if len(given) == 1 else given[0].unionByName(given[1]), limits, accepts)
    measures, texts = musthaves.numbers(places, key), musthaves.categories(places, key)
    out = musthaves.tested(_every_pair(places, searches), key, measures, texts, alternatives or {})
    return out.withColumn("status", F.when(F.size("failed") > 0, EXCLUDED).when(F.size("unknown") > 0, UNKNOWN).otherwise(MATCH))


def all_match(places: DataFrame, key: str, searches: DataFrame) -> DataFrame:
    """Statuses of searches without must-haves."""
    rows = _every_pair(places.select(key), searches.select("search").distinct())
    empty = F.array().cast("array<string>")
    return rows.select("search", key, empty.alias("failed"), empty.alias("unknown"), F.lit(MATCH).alias("status"))


def shown(status: Column | str, include_unknown: bool = True) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return s.isin(MATCH, UNKNOWN) if include_unknown else s == MATCH


def result_order(key: str) -> list[Column]:
    """Verified matches first, best score first, unscored last, then the key."""
    return [F.asc("status"), F.desc_nulls_last("score"), F.asc(key)]


def ranked(scored: DataFrame, key: str, n: int, include_unknown: bool = True) -> DataFrame:
    """The best ``n`` places of each search with their position."""
    return rank.top_k(scored.filter(shown("status", include_unknown)), ["search"], result_order(key), n)


def explain(known: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Per (search, place): up to ``n`` measures that pushed the score up and down, strongest first.

    A search weighs a few dozen measures at most, so the list per place is short.
    """
    def side(sign: int) -> Column:
        picked = F.filter(F.collect_list(F.struct((F.col("impact") * -sign).alias("o"), F.col("metric").alias("m"))),
                          lambda x: x["o"] < 0)
        return F.transform(F.slice(F.array_sort(picked), 1, n), lambda x: x["m"])
    return known.groupBy("search", key).agg(side(1).alias("strengths"), side(-1).alias("weaknesses"))


def unasked(criteria: DataFrame, watched: Sequence[str]) -> DataFrame:
    """(search, metric): the watched measures to which a search gives no weight."""
    weighed = F.collect_set(F.when(P.clamp_weight("weight") > 0, F.col("metric")))
    left = F.array_except(F.array(*[F.lit(m) for m in watched]), weighed)
    return criteria.groupBy("search").agg(left.alias("_left")).select("search", F.explode("_left").alias("metric"))


def watch_outs(ranked_rows: DataFrame, key: str, watched: Sequence[str], asked: DataFrame, share: float = 5.0,
               listed: DataFrame | None = None) -> DataFrame:
    """Measures nobody asked about on which a place is among the worst ``share`` % (worse = higher).

    ``listed`` (search, place): only for these results, met by place; else for all places of each search.
    """
    worst = ranked_rows.filter(F.col("metric").isin(*watched) & (F.col("lo") >= 100 - share))
    worst = worst.select(key, "metric", F.floor("lo").cast("long").alias("worse_than"))
    if listed is not None:
        worst = listed.select("search", key).join(worst, key)
        return worst.join(unasked(asked, watched), ["search", "metric"]).select("search", "metric", key, "worse_than")
    return worst.join(unasked(asked, watched), "metric").select("search", "metric", key, "worse_than")
