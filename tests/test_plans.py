"""Plans: no nested loops, no Python in the data path, filters and columns reach the scan."""

import pytest

from plumbline.operators import logs as L
from plumbline.operators import profile as P
from plumbline.plans import QUERIES

RUNS_JOBS = {"full_audit", "compact_files", "zorder_rewrite", "partition_rewrite"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q not in RUNS_JOBS and not q.startswith("stream_")))
def test_no_nested_loops_and_no_python(name, spark, root):
    plan = plan_of(QUERIES[name](spark, root))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in plan


def test_since_is_pushed_to_the_scan(t):
    plan = plan_of(L.since(t.events, "ts", "2024-01-31 00:00:00", 7).groupBy("event_type").count())
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan


def test_profile_of_two_columns_reads_two_columns(t):
    plan = plan_of(P.column_profile({"orders": t.orders}, columns=["o_orderstatus", "o_custkey"]))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_approximate_profile_has_no_wide_shuffle(t):
    plan = plan_of(P.column_profile({"orders": t.orders}, mode="approx"))
    assert "hashpartitioning" not in plan


def test_string_minima_do_not_sort(t):
    plan = plan_of(P._stats("orders", t.orders, P.scalar_fields(t.orders), None))
    assert "SortAggregate" in plan and "Sort [" not in plan and "hashpartitioning" not in plan
