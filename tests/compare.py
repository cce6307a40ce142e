"""Run a registered query on Spark and its SQL on DuckDB and compare the results."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(v):
    return type(v).__name__


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql: str, tol: float = 0.0) -> tuple[bool, str]:
    got = df.collect()
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    a, b = rows(df.columns, got), rows(cols, want)
    names = sorted(df.columns)
    for x, y in zip(a, b):
        for n, u, v in zip(names, x, y):
            if u is not None and v is not None and kind(u) != kind(v):
                return False, f"type of {n}: {kind(u)} {u!r} vs {kind(v)} {v!r}"
            if u != v and not (tol and isinstance(u, float) and abs(u - v) <= tol):
                return False, f"value of {n}: {x} vs {y}"
    return True, f"{len(got)} rows"
