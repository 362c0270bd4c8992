"""County-level searches over places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import musthaves, rank, score
from ..session import durable
from . import base
from .ranking import LONG, _bounds_sql, _long
from .registry import query, r, rs, rt, rts, with_

MEASURES = ["balance", "spend", "orders"]

# The searches: id, metric, weight, direction.
CRITERIA_ROWS = [
    ("rich", "balance", 5.0, "higher"), ("rich", "spend", 3.0, "higher"),
    ("quiet", "orders", 4.0, "lower"), ("quiet", "balance", 9.0, "middle"), ("quiet", "spend", 0.0, "higher"),
]
LIMIT_ROWS = [("rich", "balance", 0.0, None), ("rich", "orders", 5.0, 30.0), ("quiet", "spend", None, 2500000.0)]
ACCEPT_ROWS = [("rich", "segment", ["BUILDING", "MACHINERY", "AUTOMOBILE"]), ("quiet", "segment", [])]

CRITERIA = """criteria AS (SELECT search, metric, least(5, greatest(0, weight))::DOUBLE AS weight, direction FROM (VALUES
  ('rich','balance',5,'higher'), ('rich','spend',3,'higher'),
  ('quiet','orders',4,'lower'), ('quiet','balance',9,'middle'), ('quiet','spend',0,'higher'))
  v(search, metric, weight, direction) WHERE least(5, greatest(0, weight)) > 0)"""
CONTRIB = """contrib AS (
  SELECT search, place, b.metric, value, c.direction, weight, (lo + hi) / 2 AS percentile,
    CASE c.direction WHEN 'higher' THEN hi WHEN 'lower' THEN 100 - lo ELSE 100 - 2 * abs((lo + hi) / 2 - 50) END AS points,
    CASE c.direction WHEN 'higher' THEN lo WHEN 'lower' THEN 100 - hi END AS beats
  FROM bounds b JOIN criteria c USING (metric))"""
STATUS = """status AS (
  SELECT 'rich' AS search, place,
    CASE WHEN balance < 0 OR orders < 5 OR orders > 30 OR (segment NOT IN ('BUILDING','MACHINERY','AUTOMOBILE') AND alt_segment IS NULL) THEN 2
         WHEN balance IS NULL THEN 1 ELSE 0 END AS status,
    concat_ws(';', CASE WHEN balance < 0 THEN 'balance' END, CASE WHEN orders < 5 OR orders > 30 THEN 'orders' END,
      CASE WHEN segment NOT IN ('BUILDING','MACHINERY','AUTOMOBILE') AND alt_segment IS NULL THEN 'segment' END) AS failed,
    concat_ws(';', CASE WHEN balance IS NULL THEN 'balance' END) AS unknown FROM places
  UNION ALL
  SELECT 'quiet', place, 2, concat_ws(';', CASE WHEN spend > 2500000 THEN 'spend' END, 'segment'),
    concat_ws(';', CASE WHEN spend IS NULL THEN 'spend' END) FROM places)"""
SCORED = """scored AS (
  SELECT s.search, s.place, s.status, s.failed, s.unknown,
    CASE WHEN s.status <> 2 THEN (coalesce(sw, 0) + 50 * (tot - coalesce(w, 0))) / tot END AS score,
    (asked - coalesce(kn, 0))::BIGINT AS missing
  FROM status s JOIN (SELECT search, sum(weight) AS tot, count(*) AS asked FROM criteria GROUP BY search) USING (search)
  LEFT JOIN (SELECT search, place, sum(weight * points) AS sw, sum(weight) AS w, count(*) AS kn FROM contrib GROUP BY ALL) c
    ON c.search = s.search AND c.place = s.place)"""
BOUNDS = _bounds_sql("PARTITION BY metric")
SEARCH_SQL = (*base.PLACE_SQL, LONG, BOUNDS, CRITERIA, CONTRIB, STATUS, SCORED)


def criteria(t):
    return t.rows(CRITERIA_ROWS, "search string, metric string, weight double, direction string")


def limits(t):
    return t.rows(LIMIT_ROWS, "search string, metric string, min double, max double")


def accepts(t):
    return t.rows(ACCEPT_ROWS, "search string, category string, accept array<string>")


def _known(t):
    return score.contributions(base.places(t), "place", criteria(t), MEASURES)


def _statuses(t):
    p = base.places(t).select("place", "segment", "alt_segment", *MEASURES)
    return score.filter_results(p, "place", limits(t), accepts(t), {"segment": "alt_segment"})


def _scored(t):
    return score.scores(base.places(t), "place", criteria(t), _known(t), _statuses(t))


@query("E3 E4 F1 F23", with_(*SEARCH_SQL, select=f"""SELECT search, place, metric, value, direction, {rs('percentile')} AS percentile,
  {rs('points')} AS points, weight, {rs('weight * (points - 50)')} AS impact, {rs('beats')} AS beats FROM contrib"""))
def search_contributions(t):
    c = _known(t)
    return c.select("search", "place", "metric", "value", "direction", r("percentile").alias("percentile"),
                    r("points").alias("points"), "weight", r("impact").alias("impact"), r("beats").alias("beats"))


@query("E2 F23", with_(*SEARCH_SQL, select=f"SELECT search, place, metric, {rs('points')} AS points FROM contrib"))
def search_on_saved_bounds(t):
    """The bounds table is written once; the search only looks values up in it."""
    saved = durable(rank.value_bounds(_long(t), ["metric"]))
    c = score.contributions(base.places(t), "place", criteria(t), MEASURES, bounds=saved)
    return c.select("search", "place", "metric", r("points").alias("points"))


@query("F2 F3", with_(*SEARCH_SQL, select="SELECT search, place, status::BIGINT AS status, failed, unknown FROM status"))
def must_haves(t):
    s = _statuses(t)
    return s.select("search", "place", F.col("status").cast("long"), F.array_join("failed", ";").alias("failed"),
                    F.array_join("unknown", ";").alias("unknown"))


@query("D39", with_(*SEARCH_SQL, select="""SELECT search, count(*) FILTER (WHERE status = 0) AS match, count(*) FILTER (WHERE status = 1) AS unknown,
  count(*) FILTER (WHERE status = 2) AS excluded FROM status GROUP BY 1"""))
def search_status_counts(t):
    p = durable(base.places(t).select("place", "segment", "alt_segment", *MEASURES))
    found = musthaves.shown_places(p, "place", criteria(t), limits(t), accepts(t), {"segment": "alt_segment"})
    return musthaves.shown_counts(found, criteria(t), p)


@query("F1 F2 F3 F23", with_(*SEARCH_SQL, select=f"SELECT search, place, status::BIGINT AS status, {rts('score')} AS score, missing FROM scored"))
def search_scores(t):
    return _scored(t).select("search", "place", F.col("status").cast("long"), rt("score").alias("score"), "missing")


@query("F4 E7", with_(*SEARCH_SQL, select=f"""SELECT search, place, status::BIGINT AS status, {rts('score')} AS score, position FROM (
  SELECT *, row_number() OVER (PARTITION BY search ORDER BY status, round(score, 9) DESC NULLS LAST, place) AS position
  FROM scored WHERE status < 2) WHERE position <= 100"""))
def search_ranking(t):
    s = _scored(t).withColumn("exact", F.col("score")).withColumn("score", r("score", 9))
    top = score.ranked(s, "place", 100)
    return top.select("search", "place", F.col("status").cast("long"), rt("exact").alias("score"), F.col("position").cast("long"))


@query("F5", with_(*SEARCH_SQL, """imp AS (SELECT *, weight * (points - 50) AS impact FROM contrib)""",
                   select="""SELECT search, place,
  coalesce(string_agg(metric, ';' ORDER BY impact DESC, metric) FILTER (WHERE impact > 0), '') AS strengths,
  coalesce(string_agg(metric, ';' ORDER BY impact, metric) FILTER (WHERE impact < 0), '') AS weaknesses
  FROM imp GROUP BY search, place"""))
def search_explanations(t):
    e = score.explain(_known(t), "place")
    return e.select("search", "place", F.array_join("strengths", ";").alias("strengths"),
                    F.array_join("weaknesses", ";").alias("weaknesses"))


@query("F6", with_(*SEARCH_SQL, select="""SELECT s.search, place, metric, floor(lo)::BIGINT AS worse_than FROM bounds
  CROSS JOIN (SELECT DISTINCT search FROM criteria) s
  WHERE lo >= 95 AND metric IN ('spend', 'orders') AND NOT EXISTS (
    SELECT 1 FROM criteria c WHERE c.search = s.search AND c.metric = bounds.metric)"""))
def search_watch_outs(t):
    rows = rank.rank_rows(_long(t), ["place"], ["metric"])
    return score.watch_outs(rows, "place", ["spend", "orders"], criteria(t)).select("search", "place", "metric", "worse_than")


@query("B22 E1 E2 E4 F1 F2 F4", with_(*base.PLACE_SQL, "scope AS (SELECT * FROM places WHERE state <> 4)",
  LONG.replace("FROM places", "FROM scope"), BOUNDS, """contrib AS (
  SELECT place, CASE metric WHEN 'balance' THEN 5 WHEN 'spend' THEN 3 ELSE 2 END AS weight,
    CASE metric WHEN 'orders' THEN 100 - lo ELSE hi END AS points FROM bounds)""",
  """scored AS (SELECT p.place, CASE WHEN balance IS NULL THEN 1 ELSE 0 END AS status,
    (coalesce(sum(weight * points), 0) + 50 * (10 - coalesce(sum(weight), 0))) / 10 AS score
  FROM scope p LEFT JOIN contrib c ON p.place = c.place WHERE coalesce(balance, 0) >= 0 GROUP BY ALL)""",
  select=f"SELECT place, status::BIGINT AS status, {rts('score')} AS score FROM scored ORDER BY status, round(score, 9) DESC, place LIMIT 50"))
def place_search(t):
    """The flagship: scope, ranks, points, weighted score, a must-have, the best fifty."""
    scope = base.places(t).filter(F.col("state") != 4)
    asked = t.rows(
        [("s", "balance", 5.0, "higher"), ("s", "spend", 3.0, "higher"), ("s", "orders", 2.0, "lower")],
        "search string, metric string, weight double, direction string")
    must = t.rows([("s", "balance", 0.0, None)], "search string, metric string, min double, max double")
    known = score.contributions(scope, "place", asked, MEASURES)
    statuses = score.filter_results(scope.select("place", "balance"), "place", must)
    scored = score.scores(scope, "place", asked, known, statuses)
    scored = scored.withColumn("exact", F.col("score")).withColumn("score", r("score", 9))
    best = scored.filter(score.shown("status")).orderBy(*score.result_order("place")).limit(50)
    return best.select("place", F.col("status").cast("long"), rt("exact").alias("score"))


# --- a search per customer: places like the customer's own -----------------

OWN_CRITERIA = [("balance", 5.0, "higher"), ("orders", 2.0, "lower")]
LIKE_SQL = (*base.PLACE_SQL, LONG, BOUNDS, """pairs AS (
  SELECT o.place AS search, p.place, CASE WHEN o.balance IS NOT NULL AND p.balance IS NULL THEN 1 ELSE 0 END AS status
  FROM places o JOIN places p ON (p.balance BETWEEN o.balance - 300 AND o.balance + 300 OR p.balance IS NULL OR o.balance IS NULL)
    AND p.orders <= o.orders AND (p.segment = o.segment OR coalesce(p.alt_segment = o.segment, false)))""",
  """points AS (SELECT place, (5 * coalesce(max(hi) FILTER (WHERE metric = 'balance'), 50) + 2 * (100 - max(lo) FILTER (WHERE metric = 'orders'))) / 7 AS score
  FROM bounds GROUP BY place)""")


def _customers(t):
    """Places, and per place a search: a balance near its own, no more orders, its own segment."""
    p = durable(base.places(t).select("place", "segment", "alt_segment", *MEASURES))
    own = F.col("place").alias("search")
    must = p.select(own, F.explode(F.array_compact(F.array(
        F.when(F.col("balance").isNotNull(), F.struct(F.lit("balance").alias("metric"), (F.col("balance") - 300).alias("min"), (F.col("balance") + 300).alias("max"))),
        F.struct(F.lit("orders").alias("metric"), F.lit(None).cast("double").alias("min"), F.col("orders").cast("double").alias("max"))))).alias("m")).select("search", "m.*")
    kinds = p.select(own, F.lit("segment").alias("category"), F.array("segment").alias("accept"))
    return p, musthaves.Asked(p, "place", p.select(own), must, kinds, {"segment": "alt_segment"})


@query("F2 F3 F23 D39", with_(*LIKE_SQL, select="""SELECT search, count(*) FILTER (WHERE status = 0) AS match, count(*) FILTER (WHERE status = 1) AS unknown,
  (SELECT count(*) FROM places) - count(*) AS excluded FROM pairs GROUP BY search"""))
def customer_search_counts(t):
    p, like = _customers(t)
    return musthaves.shown_counts(like, p.select(F.col("place").alias("search")), p)


@query("F1 F2 F3 F4 F23", with_(*LIKE_SQL, select=f"""SELECT search, place, status::BIGINT AS status, {rts('score')} AS score, position FROM (
  SELECT *, row_number() OVER (PARTITION BY search ORDER BY status, round(score, 9) DESC, place) AS position FROM pairs JOIN points USING (place)) WHERE position <= 3"""))
def customer_search_results(t):
    """The best three places of a search per customer."""
    p, like = _customers(t)
    ranked = rank.rank_rows(rank.unpivot(p, ["place"], MEASURES), ["place"], ["metric"])
    asked = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(w).alias("weight"), F.lit(d).alias("direction")) for m, w, d in OWN_CRITERIA])
    asked = p.select(F.col("place").alias("search"), F.explode(asked).alias("a")).select("search", "a.*")
    ranked = durable(ranked)
    found = musthaves.best_places(like, ranked, asked, 3, lambda score: r(score, 9))
    scored = musthaves.shown_scores(found, "place", ranked, asked)
    scored = scored.withColumn("exact", F.col("score")).withColumn("score", r("score", 9))
    best = score.ranked(scored, "place", 3)
    return best.select("search", "place", F.col("status").cast("long"), rt("exact").alias("score"), F.col("position").cast("long"))
