"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

ROOT = "/root/testdata/sf0.001"


def connect(root: str = ROOT):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in Path(root).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        assert not math.isnan(v), "not a number in a result"
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, query, sql: str, root: str = ROOT) -> None:
    df = query(spark, root)
    got = rows_of(df.columns, df.collect())
    want = connect(root).sql(sql)
    assert got == rows_of(want.columns, want.fetchall())
