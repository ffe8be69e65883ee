"""Every registered query against its SQL twin on the smallest star tables."""

import pytest
from compare import connect, differences
from conftest import SMALL

import __spark_entry__ as entry_module
from mergelens.plans.oracle import ORACLE
from mergelens.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    con = connect(SMALL)
    yield con
    con.close()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert differences(QUERIES[name](spark, SMALL), duck, ORACLE[name]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
