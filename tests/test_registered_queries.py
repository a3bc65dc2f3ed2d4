"""Every registered query on the smallest tables, against its SQL where there is one."""

import pytest

import __spark_entry__ as contract
from tools import compare

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # no cross products, and no row-at-a-time Python functions
    assert not any(node in plan for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"))
    got = compare.spark_rows(df)
    if name in ORACLES:
        assert compare.difference(got, compare.duck_rows(duck, ORACLES[name])) is None
    else:
        assert got[1]


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
