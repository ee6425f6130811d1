"""Every registered query of the engine against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from ledgerlark.plans import registry
from tests import oracle

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    assert oracle.difference(spark, duck, QUERIES[name], ORACLES[name], DIR) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 100
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
