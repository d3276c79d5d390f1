"""Every registered query of the library proper runs on the smallest files and agrees with its SQL; those of ``llm`` have tests of their own."""

import pytest
from compare import compare, connect
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries
from sitegrain.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SMALL, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_entry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
