"""Every registered query against its SQL on the smallest tables."""

import pytest
from verify import compare, connect

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note


def test_entry(spark):
    assert driver.entry(spark).columns


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
