"""Every registered query against DuckDB on the smallest data (``workload.check_oracle`` does it at any scale)."""

import pytest

import __spark_entry__ as main
from workload.check_oracle import connect, difference
from workload.oracle import ORACLE
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(main.queries()) and set(ORACLE) <= set(main.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLE[name]) is None


def test_entry(spark):
    row = main.entry(spark).collect()[0]
    assert sum(row[f"lexicon_{x}"] for x in ("negative", "neutral", "positive")) > 0
    assert sum(row) % 2 == 0
