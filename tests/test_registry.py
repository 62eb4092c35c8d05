"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, sql_connection

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return sql_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, queries()[name], oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_returns_rows(spark, con, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry(spark, con):
    assert entry(spark).count() > 0
