"""Every registered query against DuckDB on the same parquet."""

from __future__ import annotations

import pytest

import __spark_entry__ as registry
from tests.compare import connect, difference

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf, con):
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_is_nested_and_whole(spark):
    tree = registry.entry(spark)
    assert [f.name for f in tree.schema] == [
        "subject", "slug", "strand_id", "name", "part", "subStrands",
    ]
    total = tree.selectExpr("aggregate(subStrands, 0, (n, s) -> n + size(s.indicators)) AS n")
    assert total.groupBy().sum("n").first()[0] == 1500
