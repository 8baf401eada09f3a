"""Order-free comparison of a Spark result with a DuckDB one."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    kind = type(x).__name__
    if kind.startswith("float"):
        return round(float(x), 6)
    if kind.startswith("bool"):
        return bool(x)
    if kind.startswith(("int", "uint")):
        return int(x)
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(cell(x) for x in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)
