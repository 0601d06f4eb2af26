"""Registered queries against DuckDB, on the smallest data."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connection

SF_DIR = entry.SMALLEST
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


def test_every_query_has_sql():
    """The corpus queries have tests of their own where SQL cannot express them."""
    assert set(entry.queries()) - set(entry._corpus_queries()) == set(SQL) - set(entry._corpus_queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name, SQL[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
