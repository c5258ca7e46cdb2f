"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    n, state = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert state in ("ok", "rows only"), state


def test_entry(spark):
    assert entry.entry(spark).count() == 30
