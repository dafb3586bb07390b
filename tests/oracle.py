"""Runs SQL over the test tables and brings both sides to comparable rows."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


def canonical(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float) and not isinstance(v, bool):
            return repr(int(v)) if v == int(v) else f"{v:.9g}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False, name=None))
