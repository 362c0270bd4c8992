"""School scores from enrollment counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import clip, known_sum
from ..session import DEFAULT_LIMITS, Limits
from .rank import average_rank_percentile


def reported_total(parts: Sequence[str]) -> Column:
    """Sum of the counts, negative reserve codes ignored; unknown when none is a count."""
    return known_sum([F.when(F.col(p) >= 0, F.col(p)) for p in parts])


def access_scores(df: DataFrame, key: str, taking: Sequence[str], enrollment: str, courses: str, score: str = "score", pctl: str = "pctl",
                  limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """College-prep access: the mean of two national percentiles (share of students taking part, courses
    offered), then ranked again."""
    share = clip(100 * reported_total(taking) / F.when(F.col(enrollment) > 0, F.col(enrollment)), 0, 100)
    rows = df.withColumn("share", share).filter(F.col("share").isNotNull() & F.col(courses).isNotNull())
    rows = average_rank_percentile(rows, [key], [], "share", "_a", limits)
    rows = average_rank_percentile(rows, [key], [], courses, "_b", limits)
    rows = rows.withColumn(score, F.round((F.col("_a") + F.col("_b")) / 2, 9)).drop("_a", "_b")
    return average_rank_percentile(rows, [key], [], score, pctl, limits)
