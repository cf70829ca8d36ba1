"""Spark results against DuckDB's, as multisets of rows."""

import datetime
import decimal
import os
from collections import Counter

import duckdb
import numpy as np


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def views(d):
    con = duckdb.connect()
    for f in sorted(os.listdir(d)):
        p = f"{d}/{f}"
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def compare(df, con, sql):
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    mine = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
