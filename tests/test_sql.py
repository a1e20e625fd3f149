"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from check_sql import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, text = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    assert ok, text


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
