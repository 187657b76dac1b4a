"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from textloom.plans import catalogue, oracles


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(found, columns, order):
    fix = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(fix(r[columns.index(c)]) for c in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    mine = catalogue.queries()[name](spark, sf_dir)
    want = duck.sql(oracles.SQL[name])
    order = sorted(want.columns)
    assert sorted(mine.columns) == order
    assert rows(mine.collect(), mine.columns, order) == rows(want.fetchall(), want.columns, order)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(oracles.SQL)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
