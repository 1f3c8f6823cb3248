"""Every registered query against its SQL; no plan has a cross join."""

import pytest

import __spark_entry__ as entry_module
from recordflow.plans.registry import ORACLE, QUERIES
from tests.oracle_check import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, con, name):
    assert name in entry_module.oracle_sql()
    assert compare(spark, con, name, SF_DIR) == []


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["record_id", "label", "value"]


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
