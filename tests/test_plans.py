"""Shapes of physical plans: what must not be in them, and what must reach the scan."""

import re

import pytest

from telemill.plans import store_queries, views
from telemill.plans.registry import REGISTERED

SF = "/root/testdata/sf0.001"
STREAMED = {name for name in REGISTERED if name.startswith("stream_")} | {"stored_spans"} | set(store_queries.QUERIES)
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas", "SinglePartition")


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTERED) - STREAMED))
def test_no_plan_pairs_everything_or_leaves_the_jvm(spark, name):
    plan = plan_of(REGISTERED[name][0](spark, SF))
    found = [bad for bad in FORBIDDEN if bad in plan]
    if name == "analysis_report":  # counts of a few findings, one row per part
        found = [f for f in found if f != "SinglePartition"]
    assert not found, plan


def test_columns_and_filters_reach_the_scan(spark):
    nodes = plan_of(REGISTERED["service_nodes"][0](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", nodes).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"event_id", "ts", "event_type", "value"}
    searched = plan_of(REGISTERED["query_spans"][0](spark, SF))
    assert "EqualTo(event_type,purchase)" in searched and "TakeOrderedAndProject" in searched


def test_search_filters_reach_the_scan(spark, tmp_path):
    from telemill.operators import logs, spans
    from telemill.sources import tables

    path = str(tmp_path / "spans")
    tables.write_table(views.spans(spark, SF), path, tables.SPANS)
    stored = tables.read_table(spark, path)
    plan = plan_of(spans.search_traces(stored, "2024-01-02", "2024-01-03", service="error", status=2))
    assert "EqualTo(service_name,error)" in plan and "EqualTo(status,2)" in plan and "SortMergeJoin" not in plan.split("LeftSemi")[0]
    one = plan_of(spans.get_spans(stored, "t1", "2024-01-02", "2024-01-03"))
    assert "EqualTo(trace_id,t1)" in one and re.search(r"PartitionFilters: \[isnotnull\(_date", one)
    path = str(tmp_path / "logs")
    tables.write_table(views.logs(spark, SF), path, tables.LOGS)
    near = plan_of(logs.log_context(tables.read_table(spark, path), "t1", "2024-01-02", "2024-01-03"))
    assert "EqualTo(trace_id,t1)" in near and re.search(r"PartitionFilters: \[isnotnull\(_date", near)


def test_edges_shuffle_parents_once(spark):
    """The parents are grouped on the join key, so the join adds no exchange on their side."""
    from telemill.operators.service_map import calls

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables too large to broadcast
    plan = plan_of(calls(views.spans(spark, SF)))
    # children: count, then join key; parents: once; result: once
    assert plan.count("Exchange hashpartitioning") == 4


def test_rules_filter_metric_names_at_the_scan(spark, tmp_path):
    from telemill.operators.alerts import rule_points
    from telemill.operators.metrics import Selector
    from telemill.sources import tables

    path = str(tmp_path / "metrics")
    tables.write_metrics(views.event_metrics_of(views.table(spark, SF, "events")), path)
    tagged = rule_points(
        tables.read_table(spark, path), {"r": Selector("app_value", [("type", "=", "x")]), "q": Selector("up")}, "2024-01-02", "2024-01-03"
    )
    plan = plan_of(tagged)
    assert "In(name, [app_value,up])" in plan and re.search(r"PartitionFilters: \[isnotnull\(_date", plan)
