"""Every query against its SQL in DuckDB."""

import pytest

from check import compare, connect
from slipmark.queries import all_oracles, all_queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("key", list(all_queries()))
def test_query_equals_sql(spark, duck, key):
    ok, note = compare(spark, duck, all_queries()[key], all_oracles().get(key), SMALL)
    assert ok, note


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 6
