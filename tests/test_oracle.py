"""Every registered query with SQL gives DuckDB's result."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from tabwright import catalog

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
# the optional training-data queries have tests of their own
OWN = catalog.all_queries()
QUERIES = {name: build for name, build in entry.queries().items() if name in OWN}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in OWN}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, con):
    assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert ("value", "High Skew") in {(r["feature"], r["issue"]) for r in rows}
