"""Compares a query's rows with its SQL's in DuckDB."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(names)
    return cols, sorted((tuple(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in got.fetchall()), key=repr)
