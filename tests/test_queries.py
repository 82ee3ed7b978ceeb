"""Every registered query against DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from rulewright.plans import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    _, diff = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert diff is None, diff


def test_entry(spark):
    assert entry.entry(spark).count() > 0
