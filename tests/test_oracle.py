"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from routeboard.plans.catalog import QUERIES
from routeboard.plans.oracle import ORACLE
from tests.conftest import SF_SMALL
from tools.check_oracle import compare, is_ordered, register_views

NAMES = sorted(QUERIES)   # the optional subpackage tests its own


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    register_views(c, SF_SMALL)
    return c


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    same, s_rows, o_rows, s_cols, o_cols = compare(sdf, con, entry.oracle_sql()[name], is_ordered(name))
    assert sorted(s_cols) == sorted(o_cols)
    assert len(s_rows) == len(o_rows)
    assert same


def test_a_wrong_order_is_seen(spark, con):
    name = "r16_route_totals"
    turned = entry.queries()[name](spark, SF_SMALL).orderBy("path")
    assert compare(turned, con, entry.oracle_sql()[name])[0]
    assert not compare(turned, con, entry.oracle_sql()[name], is_ordered(name))[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "total_transactions", "unique_users", "total_volume"]
    assert df.count() > 0
