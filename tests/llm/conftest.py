from datetime import datetime  # noqa: F401

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `__size` string"


@pytest.fixture(scope="session")
def documents(spark: SparkSession):
    """Builds a table of documents from (doc_id, text, source), with columns whose names clash with the operators' own."""
    def build(rows: list[tuple]) -> DataFrame:
        return spark.createDataFrame([(d, t, "en", s, len(t or ""), 0.5, "x") for d, t, s in rows], SCHEMA)
    return build
