"""Operator 10, mixing sources to target weights: Pareto order sampling, in DataFrame functions alone.

Targets: each source's share of ``fraction`` of all words by its weight, stopped at ``most`` times its own words, the
excess shared again by weight (the level at which it all fits is found from running sums over the sources). A source's
documents all get the whole copies that are certain; the rest is a sample of fixed size in words: documents are ranked by
their random odds over their inclusion odds and taken in that order until the source's remainder is reached. Inclusion odds
are those of the remainder's share, smaller for a document the longer it is beside its source's mean, so that a few very
long documents don't decide how near a mix comes to its target.

The order is never sorted as a whole: ranks fall into about as many buckets as the root of a source's documents, sums of words per
source and bucket (made before the shuffle) tell the bucket in which the cut lies, and only that bucket's documents are put in
order, rows alike as one with their number. A hot source costs each task its own sums.

Edges: null text has size 0; null is a source of its own, after all others; documents of size 0 are never taken; random
numbers come from doc_id and text, so reruns agree and null or repeated ids draw for each text; rows alike in both lie at one
place in the order, and where the cut goes through them as many are taken as bring the sum nearest; other columns are ignored, or
pass in ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_checked, durable

BUCKETS = 1024   # at least
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """A name for an id and a text, the same in every run."""
    content = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), content).cast("binary"))


def unit(name: Column) -> Column:
    """A number above 0 and below 1 from a name of hexadecimal digits."""
    return (F.conv(F.substring(name, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0 ** 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), fraction: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``documents``, ``target`` from one row per source (source, source_size, documents).

    One row per source meets in one task: a table of sources, not of documents.
    """
    everything = Window.partitionBy(F.lit(0))
    named = sizes.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    named = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    total = F.sum("source_size").over(everything) * F.lit(float(fraction))
    # by the level at which a source is full: with all fuller ones full, what is the level of the rest?
    order = everything.orderBy(F.col("cap") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = named.withColumn("level", level).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    # the first source that isn't full sets the level
    common = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everything)["level"]
    target = F.when(common.isNull(), F.col("cap")).otherwise(F.least("cap", common * F.col("weight")))
    return ranked.select("source", "source_size", "documents", target.alias("target"))


def _sized(docs: DataFrame, *kept: Column) -> DataFrame:
    return docs.select(*kept, "source", words(F.col("text")).alias("__size"), draw(F.col("doc_id"), F.col("text")).alias("__draw"))


def _ranked(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """Rows with ``size``, and their source's goal, their rank, bucket and place in the order in which a source's documents are taken.

    One row per source is broadcast, if they are few.
    """
    mean = F.col("source_size") / F.greatest("documents", F.lit(1))
    r = unit(F.col("__draw"))
    odds = F.col("part") / (1 - F.col("part")) * (mean / (mean + F.col("__size")))
    ratio = (r / (1 - r)) / odds
    return (sized.join(broadcast_checked(goal), sized["source"].eqNullSafe(goal["__source"])).drop("__source")
            .withColumn("rank", F.when((F.col("part") > 0) & (F.col("__size") > 0), ratio / (1 + ratio)))
            .withColumn("bucket", F.floor(F.col("rank") * F.col("buckets")))
            .withColumn("place", F.struct("rank", "__draw", "__size")))


def goals(sized: DataFrame, weights: tuple[float, ...], fraction: float, most: float) -> DataFrame:
    """One row per source: its target, the whole copies, the last place in order that is taken once more, how many rows
    are there and how many of them are taken.

    ``sized``: source, ``__size`` and ``__draw``, durable.
    """
    per_source = sized.groupBy("source").agg(F.sum("__size").alias("source_size"), F.count_if(F.col("__size") > 0).alias("documents"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = targets(per_source, weights, fraction, most).withColumn("whole", F.floor(rate + 1e-9).cast("long"))
    goal = goal.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    goal = goal.withColumn("buckets", F.greatest(F.lit(BUCKETS).cast("long"), F.ceil(F.sqrt("documents"))))
    goal = durable(goal.withColumn("part", F.least(F.lit(1 - 1e-9), F.col("left") / F.greatest(F.col("source_size"), F.lit(1))))
                   .withColumnRenamed("source", "__source"))
    ranked = _ranked(sized, goal)
    sums = ranked.where("bucket IS NOT NULL").groupBy("source", "bucket", "left").agg(F.sum("__size").alias("words"))
    by = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("before", F.sum("words").over(by) - F.col("words"))
    cuts = (sums.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
            .select(F.col("source").alias("__source"), F.col("bucket").alias("cut"), "before"))
    goal = durable(goal.join(broadcast_checked(cuts.withColumnRenamed("__source", "s")), F.col("__source").eqNullSafe(F.col("s")), "left").drop("s"))
    # documents in the bucket of the cut, in order: taken while that brings the sum nearer to the remainder
    inside = _ranked(sized, goal).where("bucket = cut").groupBy("source", "before", "left", "place").agg(F.count("*").alias("rows"))
    held = F.col("place.__size") * F.col("rows")
    by = Window.partitionBy("source").orderBy("place")
    inside = inside.withColumn("start", F.col("before") + F.sum(held).over(by) - held)
    fit = F.floor((F.col("left") - F.col("start")) / F.col("place.__size") + 0.5)
    last = (inside.withColumn("fit", F.least("rows", fit)).where("fit > 0").groupBy(F.col("source").alias("s"))
            .agg(F.max(F.struct("place", "rows", "fit")).alias("last"))
            .select("s", F.col("last.place").alias("edge"), F.col("last.rows").alias("edge_rows"), F.col("last.fit").alias("edge_fit")))
    return durable(goal.join(broadcast_checked(last), F.col("__source").eqNullSafe(F.col("s")), "left").drop("s", "before"))


def _first(ties: DataFrame) -> DataFrame:
    """``more``: whether a row is among the first ``edge_fit`` of its source. Counted by the tasks that wrote the rows."""
    numbered = durable(ties.withColumn("__n", F.monotonically_increasing_id())).withColumn("task", F.shiftright("__n", 33))
    order = Window.partitionBy("source").orderBy("task")
    counts = numbered.groupBy("source", "task").agg(F.count("*").alias("rows"))
    counts = counts.select(F.col("source").alias("s"), F.col("task").alias("t"), (F.sum("rows").over(order) - F.col("rows")).alias("before"))
    rows = numbered.join(broadcast_checked(counts), F.col("source").eqNullSafe(F.col("s")) & (F.col("task") == F.col("t")))
    number = F.col("before") + F.row_number().over(Window.partitionBy("source", "task").orderBy("__n"))
    return rows.withColumn("more", number <= F.col("edge_fit")).drop("__n", "task", "s", "t", "before")


def _copies(sized: DataFrame, goal: DataFrame) -> DataFrame:
    rows = _ranked(sized, goal)
    before_cut = F.col("bucket") < F.coalesce("cut", F.col("buckets") + 1)
    at_cut = (F.col("bucket") == F.col("cut")) & (F.col("place") <= F.col("edge"))
    rows = rows.withColumn("more", F.coalesce(before_cut | F.coalesce(at_cut, F.lit(False)), F.lit(False)))
    if goal.where("edge_fit < edge_rows").limit(1).count():
        cut_through = F.coalesce((F.col("edge_fit") < F.col("edge_rows")) & (F.col("place") == F.col("edge")), F.lit(False))
        rows = rows.where(~cut_through).unionByName(_first(rows.where(cut_through).drop("more")))
    return rows.withColumn("copies", F.when(F.col("__size") > 0, F.col("whole") + F.col("more").cast("long")).otherwise(F.lit(0).cast("long")))


def taken(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), fraction: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    sized = durable(_sized(docs, F.col("doc_id")))
    return _copies(sized, goals(sized, weights, fraction, most)).select(
        "doc_id", "source", F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), fraction: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as it is taken. Whole texts are neither sorted nor shuffled."""
    goal = goals(durable(_sized(docs)), weights, fraction, most)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    return _copies(_sized(docs, row), goal).select("__row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("__row.*")
