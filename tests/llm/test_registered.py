"""The registered queries of this subpackage against their SQL, on the smallest tables."""

import pytest

from sheaf.llm.queries import ORACLES, QUERIES
from workload.check import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, sf, name):
    ok, note = compare(spark, con, sf, name, QUERIES[name], ORACLES[name])
    assert ok, note
