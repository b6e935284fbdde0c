"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as registered
from tests.compare import connect, differences

QUERIES = registered.queries()
ORACLE = registered.oracle_sql()


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, folder, connection, name):
    assert differences(QUERIES[name](spark, folder), connection, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    result = registered.entry(spark)
    assert result.count() == 8
