"""Every registered query with SQL gives what the SQL gives, without Python or cross joins."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    ok, text, plan = compare(spark, con, name, entry.queries()[name], ORACLES[name], SF)
    assert ok, text
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonRDD", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
