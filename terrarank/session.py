"""Session settings and the two things operators need from a session: limits and durable tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Settings that hold from a laptop to a large cluster: adaptive plans, skewed joins split at run
# time, and broadcasts decided from measured sizes.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


@dataclass(frozen=True)
class Limits:
    """When to spread work inside one group. Tests lower these to walk the paths of large groups."""

    hot_rows: int = 1_000_000   # rows of one join key above which the key is salted
    salts: int = 64             # pieces a hot key is spread over
    slices: int | None = None   # ranges that ordered rows are cut into; None: the session's partitions, by size


DEFAULT_LIMITS = Limits()


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "terrarank") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="terrarank-")
    return _LOCAL_ROOTS[app]


_LOCAL_ROOTS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new, empty folder name under the shared root, for one table."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut a lineage by writing the rows as Parquet to the shared folder; survives lost executors.

    Read back, the table keeps column pruning, pushed filters and statistics.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def broadcast_checked(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting that the side has at most ``max_rows`` rows.

    Larger sides keep the planner's own choice (a shuffled join).
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(_literal(x) for x in v) + ")"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        return f"{v!r}D"
    return str(v)


def rows_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short literal list as a table held in the plan itself."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return table.select([F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])
