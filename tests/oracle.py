"""Runs a query's SQL in DuckDB and compares the rows with Spark's."""

import os

import duckdb
import numpy as np
import pandas as pd


def connection(directory):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(directory)):
        path = f"{directory}/{f}" + ("/*.parquet" if os.path.isdir(f"{directory}/{f}") else "")
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None else str(v))
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True) if len(df) else df


def assert_same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    a, b = plain(a), plain(b)
    assert len(a) == len(b)
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c]):
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
