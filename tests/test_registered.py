"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from workload import ORACLES, QUERIES
from workload.check import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


#: Approximate by design; test_search measures its recall against the exact search.
WITHOUT_SQL = {"probed_search"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL))
def test_query_agrees_with_sql(spark, con, sf, name):
    ok, note = compare(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_all_are_entry_points():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
