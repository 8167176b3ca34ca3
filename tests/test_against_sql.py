"""Every registered query beside its SQL in an independent engine."""

import pytest

from __spark_entry__ import entry, queries as registered
from oracle.compare import compare, connect
from oracle.sql import SQL
from orderlens.catalog import all_queries as queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(queries()) == set(SQL)
    assert set(queries()) <= set(registered())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    assert compare(queries()[name](spark, SF_DIR), con, SQL[name]) == []


def test_entry_returns_the_summary(spark):
    row = entry(spark).collect()
    assert len(row) == 1 and row[0]["total_order_lines"] == 6000
