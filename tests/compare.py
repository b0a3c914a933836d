"""Spark rows against DuckDB rows, as multisets."""

import decimal
import math
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, Counter(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


def duck_rows(sql, folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{folder}/{t}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(names)
    return order, Counter(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in cur.fetchall())
