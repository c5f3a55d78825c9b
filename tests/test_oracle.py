"""Every registered query against its SQL, over whole tables."""

import os

import pytest

import __spark_entry__ as driver
from tests.oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, FOLDER, driver.queries()[name], driver.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert driver.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert driver.entry(spark).limit(1).count() == 1
