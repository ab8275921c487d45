"""Comparison of a query's rows with DuckDB's over the same Parquet files."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        f = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return con


def plain(v: object) -> object:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, np.generic):
        v = v.item()
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=lambda r: tuple(map(str, r)))


def assert_same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
