"""Compare a query with its SQL twin in DuckDB."""

import os

import duckdb
import pandas as pd


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(base):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{base}/{name}'")
    return con


def _show(value) -> str:
    if not isinstance(value, (list, dict)) and pd.api.types.is_scalar(value) and pd.isna(value):
        return ""
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else repr(round(value, 9))
    if isinstance(value, pd.Timestamp):
        return str(value).removesuffix(" 00:00:00")
    return str(value)


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_show, row)) for row in frame.astype(object).itertuples(index=False))


def assert_same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
