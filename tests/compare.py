"""Rows of Spark and DuckDB side by side."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return float(v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


def by_text(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, by_text([tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()])


def duck_rows(sql: str, sf: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    at = [names.index(n) for n in columns]
    return columns, by_text([tuple(plain(r[i]) for i in at) for r in found.fetchall()])
