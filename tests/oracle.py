"""Holds a Spark result against DuckDB's for the same files."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) or (df[c].dtype == object and df[c].map(lambda x: x is None or type(x).__name__ == "Decimal").all()):
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = tidy(got), tidy(want)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            assert np.allclose(a[c], b[c], rtol=0, atol=1e-9, equal_nan=True), c
        else:
            assert (a[c].fillna("~").astype(str) == b[c].fillna("~").astype(str)).all(), c
