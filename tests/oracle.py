"""Runs a query and its SQL side by side and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb

DATA = os.environ.get("GARIMPO_TESTDATA", "/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, fn, sql, sf="sf0.01"):
    df = fn(spark, f"{DATA}/{sf}")
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = connect(sf)
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = rows(want_cols, cur.fetchall())
    assert sorted(df.columns) == sorted(want_cols), (name, df.columns, want_cols)
    assert len(got) == len(want), (name, len(got), len(want), [g for g in got if g not in set(want)][:3], [w for w in want if w not in set(got)][:3])
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, (name, len(bad), bad[:3])
    return len(got)
