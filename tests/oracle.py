"""Compares a Spark query with DuckDB SQL over the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.5f}" if isinstance(v, float) else str(v)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(_cell(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


def assert_agrees(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    expected = rows_of(con.execute(sql).fetchdf())
    assert rows_of(query(spark, sf_dir).toPandas()) == expected
