"""Every query against its SQL counterpart in a second engine."""

import pytest
from conftest import SMALL_TABLES

import __spark_entry__ as entry_points
from check_oracle import difference, duck
from oracle import ORACLE_SQL
from queuelens.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL_TABLES)


def test_every_oracle_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees(spark, con, name):
    assert difference(spark, con, name, SMALL_TABLES) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
