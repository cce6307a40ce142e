"""Every registered query with SQL gives the same rows on Spark and on DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    ok, message = compare(entry.queries()[name](spark, sf_dir), con, SQL[name])
    assert ok, message


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
