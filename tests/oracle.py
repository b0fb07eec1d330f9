"""Comparison of a query's rows with its SQL in DuckDB."""

import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


def assert_same(df, con, sql):
    got, names = con.execute(sql), None
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in got.fetchall())
    have = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    assert have == want
