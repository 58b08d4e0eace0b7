"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.sql(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    return c


def _cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return "null"
    if isinstance(x, (float, np.floating)):
        return repr(round(float(x), 6) + 0.0)
    return str(x)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].apply(lambda c: c.map(_cell))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return list(sorted(a.columns)) == list(sorted(b.columns)) and normal(a).equals(normal(b))
