"""Every registered query against its SQL, with rows on both sides."""

import os

import duckdb
import pytest

from terrarank.plans.catalog import QUERIES

from .oracle import compare, duck

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    q = QUERIES[name]
    df = q.run(spark, FOLDER)
    if q.sql is None:
        assert df.count() > 0
    else:
        why = compare(df, con, q.sql)
        if why == "no rows on either side":   # too little data: the next larger tables have rows for every query
            why = compare(q.run(spark, LARGER), duck(LARGER), q.sql)
        assert why is None, why


def test_keys_of_six_digits_are_cut_as_in_the_sql(spark, tmp_path):
    rows = [(k, k % 25, float(k)) for k in (1, 2, 89_999, 90_000, 90_009, 145_000, 300_000)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    q = QUERIES["picked_columns_and_levels"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert compare(q.run(spark, str(tmp_path)), con, q.sql) is None
