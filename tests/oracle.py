"""Compares a query with its SQL over one scale of the test data."""

import math
import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    return v.item() if isinstance(v, np.generic) else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)


def expected(sql, d):
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{d}/{f}'")
    return rows(con.execute(sql).df())
