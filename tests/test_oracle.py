"""Every registered query against its SQL form, and checks on the plans."""

import pytest

from boxtrail.plans.catalog import ORACLE, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
BATCH = sorted(set(QUERIES) - {"stream_summary"})


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, rows, _, _, note = compare(spark, con, SF, QUERIES[name], ORACLE[name])
    assert ok and rows, note


@pytest.mark.parametrize("name", BATCH)
def test_plan_has_no_products_or_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, bad
