"""Compares a registered query with its SQL in DuckDB, rows in any order, columns by name."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        c.execute(f"create view {name} as select * from read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    return round(float(v), 6) + 0.0 if hasattr(v, "__float__") and not isinstance(v, str) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)
