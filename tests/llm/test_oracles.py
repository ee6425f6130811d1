"""Corpus queries against their SQL in DuckDB, on the driver's tables."""

import pytest

from ledgerlark.llm import queries
from tests import oracle

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert oracle.difference(spark, oracle.connect(DIR), queries.queries()[name], queries.oracle_sql()[name], DIR) is None
