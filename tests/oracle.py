"""Compares registered queries with their SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd

TINY = "/root/testdata/sf0.001"


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def same_rows(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    tidy = lambda x: x[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(ours), tidy(theirs), check_dtype=False, check_exact=True)
