"""Items of a small file can be many: none are sent to every task, and they are dealt out before they are sorted."""

from bindery.plans.registry import QUERIES


def test_items_are_dealt(spark):
    plan = QUERIES["resource_of_toc_entry"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "REBALANCE_PARTITIONS_BY_COL" in plan
    below = plan[plan.index("partial_min_by") :]
    assert below.index("REBALANCE") < below.index("FileScan")
