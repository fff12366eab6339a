from __future__ import annotations

import pytest
from conftest import SMALL

import check
from __spark_entry__ import entry, oracle_sql, queries
from groundswell.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return check.duck(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert check.compare(queries()[name](spark, SMALL), con, oracle_sql()[name]) == "ok"


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())  # without the optional subpackage, every query has SQL
