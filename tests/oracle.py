"""Runs a query on Spark and its SQL on DuckDB, and compares rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else 0.0 if value == 0 else value
    return repr(value) if isinstance(value, (list, dict, tuple)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str) -> str:
    """'' or what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    names = list(rel.columns)
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got == want:
        return "" if got else "no rows"
    miss = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]
    return f"{len(got)} rows against {len(want)}; {miss}"


DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
