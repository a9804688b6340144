"""Every registered query against its DuckDB oracle on the smallest tables."""

import importlib
import os
import sys

import pytest

from tests.oracle import compare, duck

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
sys.path.insert(0, ROOT)
entry = importlib.import_module("__spark_entry__")
ORACLES = entry.oracle_sql()
# queries without SQL belong to the training-data operators, which have tests of their own
QUERIES = {k: v for k, v in entry.queries().items() if k in ORACLES}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    from suitelens.plans import all_queries
    assert set(all_queries()) <= set(ORACLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["Path", "NumTests", "NumFails", "NumErrs"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    compare(QUERIES[name](spark, SF), con, ORACLES[name])
