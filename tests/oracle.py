"""Compare registered queries with their SQL on DuckDB: ``python -m tests.oracle [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def duck(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def sorted_rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    out.sort(key=lambda row: tuple((x is None, str(type(x)), x if x is not None else 0) for x in row))
    return [columns[i] for i in order], out


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree exactly; else what differs."""
    got_cols, got = sorted_rows(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    result = con.execute(sql)
    want_cols, want = sorted_rows([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: e.g. {got[:2]} / {want[:2]}"
    if not got:
        return "no rows on either side"
    for c in range(len(got_cols)):
        kinds = {type(row[c]) for row in got if row[c] is not None}, {type(row[c]) for row in want if row[c] is not None}
        if kinds[0] != kinds[1]:
            return f"column {got_cols[c]} has types {kinds[0]} / {kinds[1]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ in {got_cols}, e.g.\n   {bad[0][0]}\n   {bad[0][1]}"
    return None


def main() -> None:
    from terrarank.plans.catalog import QUERIES
    from terrarank.session import local_session

    names = sys.argv[1:] or list(QUERIES)
    spark, con = local_session("8"), duck()
    failed = 0
    for name in [n for n in QUERIES if n in names or any(p.endswith("*") and n.startswith(p[:-1]) for p in names)]:
        start = time.time()
        try:
            df = QUERIES[name].run(spark, FOLDER)
            why = compare(df, con, QUERIES[name].sql) if QUERIES[name].sql else (None if df.count() else "no rows")
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:1200]}"
        failed += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - start:.1f}s{'' if why is None else ' ' + why}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
