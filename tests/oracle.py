"""Compares a query with its DuckDB SQL on the same tables."""

import math
import os
from decimal import Decimal
from glob import glob

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(f"{float(v):.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def duck(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for f in glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return connection


def compare(df, connection, sql):
    columns = sorted(df.columns)
    found = connection.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return len(got)
