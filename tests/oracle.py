"""Compares a query with its SQL on the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        path = os.path.join(folder, f)
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return db


def _cell(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (int, float, np.number)) and not isinstance(v, bool):
        return str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else f"{float(v):.6g}"
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False))


def check(spark, db, query, sql: str, folder: str) -> None:
    ours, theirs = query(spark, folder).toPandas(), db.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
