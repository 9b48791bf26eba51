"""Compares a query with its SQL by value, order-insensitively."""

from __future__ import annotations

import datetime
import os

import duckdb

SMALL = os.environ.get("STRATA_TEST_DIR", "/root/testdata/sf0.001")


def connect(folder: str):
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, list | tuple):
        return str([plain(y) for y in x])
    if isinstance(x, datetime.datetime):
        return str((x.astimezone(datetime.UTC) if x.tzinfo else x).replace(tzinfo=None))
    return str(x)


def same(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == want
