"""Registered queries beside their DuckDB equivalents."""

import pytest
from oracle import difference

from stillflow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert difference(spark, QUERIES[name], ORACLES[name], sf) == ""
