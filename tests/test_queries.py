"""Every registered query against its SQL, bit for bit, and the shape of its plan."""

import pytest
from compare import connect, differences

from marketlens.plans.catalogue import all_oracles, all_queries

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()
# No rows by nature, and no restaurant in this fee range among the first 150.
MAY_BE_EMPTY = {"m8_delete_all", "f5_between"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    found = differences(frame, duck, ORACLES[name])
    assert found == [] or (found == ["EMPTY"] and name in MAY_BE_EMPTY)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
