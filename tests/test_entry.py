"""Registered queries next to their SQL on the smallest test data."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from check import TABLES, _rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    own = set(driver.queries()) - set(driver.LLM_QUERIES)
    assert own <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, engine, name):
    got = driver.queries()[name](spark, FOLDER)
    rel = engine.sql(driver.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    assert _rows(got.columns, got.collect()) == _rows(rel.columns, rel.fetchall())


def test_flagship(spark):
    assert driver.entry(spark).count() > 0
