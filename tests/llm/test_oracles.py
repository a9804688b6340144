"""Queries with SQL against that SQL."""

import pytest

from suitelens.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) > 0
