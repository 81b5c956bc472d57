"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def shown(value):
    """Nulls alike, whole floats as integers (pandas makes floats of integers beside nulls), other floats to nine digits."""
    if value is None or value is pd.NA or value != value:
        return "null"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(round(value, 9))
    return str(value)


def rows(frame):
    return sorted([shown(v) for v in row] for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def assert_same(spark, sf_dir, query, sql):
    got, expected = query(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
