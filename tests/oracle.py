"""Compares a registered query with its DuckDB statement, column by column."""

import glob
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def views(directory: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{directory}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{files}'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "date"):
            v = v.date()
        try:
            return f"{float(v):.5f}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


def agree(spark, name: str, directory: str = DATA) -> None:
    import __spark_entry__ as entry

    ours = entry.queries()[name](spark, directory).toPandas()
    theirs = views(directory).execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)
