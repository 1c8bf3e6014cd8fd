"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from scanlake.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLE.get(name), SF) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["label", "frame_id", "metric", "bar", "focus"]


def test_oracle_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
