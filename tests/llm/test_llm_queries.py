"""The operators' queries against their SQL twins, and the entries of the driver contract."""

import pytest
from compare import connect, differences
from conftest import SMALL

import __spark_entry__ as entry_module
import corpus_pipeline
from mergelens.llm.oracle import ORACLE
from mergelens.llm.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    con = connect(SMALL)
    yield con
    con.close()


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries())
    assert set(ORACLE) <= set(QUERIES) and set(ORACLE) <= set(entry_module.oracle_sql())
    assert entry_module.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    assert differences(QUERIES[name](spark, SMALL), duck, ORACLE[name]) == []
