"""The query registry and the tables queries read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import rows_table


_READ: dict[tuple[str, str, str], DataFrame] = {}


def shared(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Build a frame once per query, however many steps use it."""
    def once(t: Tables) -> DataFrame:
        key = f"{build.__module__}.{build.__name__}"
        if key not in t.frames:
            t.frames[key] = build(t)
        return t.frames[key]
    return once


class Tables:
    """``t.orders`` reads ``<folder>/orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self.frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        # Reading the schema costs a job: once per session and table is enough.
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _READ:
            _READ[key] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return _READ[key]

    def rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return rows_table(self.spark, rows, schema)


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query under its function's name. ``covers`` lists inventory ids."""
    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if build.__name__ in QUERIES:
            raise ValueError(f"two queries named {build.__name__}")
        QUERIES[build.__name__] = Query(build.__name__, covers, build, sql)
        return build
    return add


def with_(*parts: str, select: str) -> str:
    """``WITH a AS (…), b AS (…) SELECT …``; repeated parts are written once."""
    seen = list(dict.fromkeys(p.strip() for p in parts))
    return "WITH " + ",\n".join(seen) + "\n" + select


def r(c: Column | str, digits: int = 6) -> Column:
    """Round a result for comparison: sums of doubles differ in the last bits between engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rs(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL; adding zero turns -0.0 into 0.0."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def rt(c: Column | str, digits: int = 6) -> Column:
    """Rounding for scores, which often end exactly in a 5: moved off the tie first, the same way in both
    engines."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 0.123 * 10 ** -digits, digits)


def rts(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE + {0.123 * 10 ** -digits!r}::DOUBLE, {digits}) + 0.0::DOUBLE)"
