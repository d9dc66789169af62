"""Compares a query with its SQL in DuckDB."""

import glob
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def assert_same(spark, sf_dir, query, sql):
    got = query(spark, sf_dir).toPandas()
    want = connection(sf_dir).sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [df[columns].astype(str).sort_values(columns).reset_index(drop=True) for df in (got, want)]
    assert len(rows[0]) == len(rows[1])
    assert rows[0].equals(rows[1]), rows[0].compare(rows[1]).head()
