"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from textloom.llm import queries
from textloom.llm.oracles import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(SQL[name])
    mine = queries.queries()[name](spark, sf_dir)
    order = sorted(want.columns)
    assert sorted(mine.columns) == order
    rows = lambda found, columns: sorted((tuple(r[columns.index(c)] for c in order) for r in found), key=str)
    assert rows(mine.collect(), mine.columns) == rows(want.fetchall(), want.columns)
