"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from spindlewatch.plans.registry import batch_queries

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [q for q in batch_queries() if q not in ("rul_score", "clean_outputs")])
def test_no_pairs_and_no_python_rows(spark, small, name):
    plan = plan_of(entry.queries()[name](spark, small))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "MapInPandas" not in plan


def read_columns(plan):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]


def test_scan_reads_only_what_is_used(spark, small):
    (columns,) = read_columns(plan_of(entry.queries()["log_alerts"](spark, small)))
    assert columns == {"event_id", "user_id", "event_type"}
    (columns,) = read_columns(plan_of(entry.queries()["simple_window"](spark, small)))
    assert "ts" not in columns


def test_filters_reach_the_scan(spark, small):
    plan = plan_of(entry.queries()["lowfreq_pairs"](spark, small))
    assert re.search(r"PushedFilters: \[[^\]]*event_type", plan)


@pytest.mark.parametrize(("name", "scans"), [("lowfreq_pairs", 4), ("trailing10", 2), ("running_totals", 2)])
def test_ordered_operators_read_little(spark, small, name, scans):
    plan = plan_of(entry.queries()[name](spark, small))
    assert plan.count("FileScan parquet") <= scans
    assert "SinglePartition" not in plan


@pytest.mark.parametrize(("name", "scans"), [("machine_status", 2), ("features_22", 6)])
def test_lookups_read_each_side_once(spark, small, name, scans):
    """By the plan that ran, where equal shuffles are shared."""
    df = entry.queries()[name](spark, small)
    df.collect()
    assert plan_of(df).split("== Initial Plan ==")[0].count("FileScan parquet") <= scans


def test_roll_up_scans_once(spark, small):
    plan = plan_of(entry.queries()["window_rollup"](spark, small))
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Exchange hashpartitioning") == 2


def test_dimension_is_broadcast_only_below_the_threshold(spark, small):
    assert "BroadcastHashJoin" in plan_of(entry.queries()["process_deviation"](spark, small))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_of(entry.queries()["process_deviation"](spark, small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
