"""Span search, traces, summaries, service map, analysis."""

import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import at, rows, span, spans
from pyspark.sql import functions as F

from telemill.functions.quantiles import quantiles_from_counts
from telemill.operators import analysis, service_map, spans as ops

WINDOW = (at(-3600), at(60))


def edges(df, start=WINDOW[0], end=WINDOW[1]):
    return {(r["source"], r["target"]): r for r in service_map.service_edges(df, start, end).collect()}


def nodes(df, start=WINDOW[0], end=WINDOW[1]):
    return {r["name"]: r for r in service_map.service_nodes(df, start, end).collect()}


def test_empty_map(spark):
    df = spans(spark)
    assert nodes(df) == {} and edges(df) == {}


def test_one_and_two_services(spark):
    one = spans(spark, span("trace-1", "span-1", service="frontend", ms=10))
    assert set(nodes(one)) == {"frontend"} and edges(one) == {}
    two = spans(
        spark, span("trace-1", "span-1", service="frontend", ms=20),
        span("trace-1", "span-2", "span-1", service="product-service", ms=14),
    )
    assert len(nodes(two)) == 2 and set(edges(two)) == {("frontend", "product-service")}


def test_edge_error_rate(spark):
    df = spans(
        spark, span("t1", "s1", service="frontend", ms=10), span("t1", "s2", "s1", "backend", 5),
        span("t2", "s3", service="frontend", ms=10), span("t2", "s4", "s3", "backend", 5, status=2),
    )
    edge = edges(df)["frontend", "backend"]
    assert edge["error_rate"] == 0.5 and edge["total_calls"] == 2 and edge["error_calls"] == 1
    assert edge["call_rate"] == pytest.approx(2 / 3660)


def test_no_edge_inside_a_service_or_without_parent(spark):
    assert edges(spans(spark, span("t1", "s1", service="backend"), span("t1", "s2", "s1", "backend"))) == {}
    assert edges(spans(spark, span("t1", "s2", "gone", "backend"))) == {}
    # A parent outside the window is not found, and span ids are only unique inside a trace.
    assert edges(spans(spark, span("t1", "s1", service="a", start=-7200), span("t1", "s2", "s1", "b"))) == {}
    df = spans(spark, span("t1", "s1", service="a"), span("t2", "s1", service="x"), span("t1", "s2", "s1", "b"))
    assert set(edges(df)) == {("a", "b")}


def test_empty_window_counts_as_a_second(spark):
    df = spans(spark, span("t", "s", service="a"))
    assert nodes(df, at(0), at(0))["a"]["call_rate"] == 1.0


def test_copies_of_a_span_do_not_multiply_calls(spark):
    copies = [span("t", "p", service="a")] * 40 + [span("t", "c", "p", "b", ms=7)] * 60
    assert edges(spans(spark, *copies))["a", "b"]["total_calls"] == 60


def test_map_against_brute_force_with_one_huge_trace_and_parent(spark):
    rng = random.Random(5)
    data = [span("huge", "root", service="hub", ms=5)]
    for i in range(900):
        if i % 3 == 0:  # a third of all rows: children of one span
            data.append(span("huge", f"h{i}", "root", f"leaf{i % 2}", ms=rng.randrange(50), status=rng.choice([0, 2])))
        else:
            parent = "" if i % 6 == 1 else f"n{i - 1 - (i % 3 == 1)}"
            data.append(span(f"t{i // 6}", f"n{i}", parent, f"svc{rng.randrange(4)}", ms=rng.randrange(50), status=rng.choice([0, 1, 2])))
    by_id = {(s["trace_id"], s["span_id"]): s for s in data}
    want = defaultdict(list)
    for s in data:
        parent = by_id.get((s["trace_id"], s["parent_span_id"]))
        if parent and parent["service_name"] != s["service_name"]:
            want[parent["service_name"], s["service_name"]].append((s["duration_ms"], s["status"] == 2))
    got = edges(spans(spark, *data))
    assert set(got) == set(want)
    for key, calls in want.items():
        d = [c[0] for c in calls]
        assert got[key]["total_calls"] == len(d) and got[key]["error_calls"] == sum(c[1] for c in calls)
        for p in (50, 95, 99):
            assert got[key][f"p{p}_latency_ms"] == pytest.approx(np.percentile(d, p))


@pytest.mark.parametrize("values", [[5], [1, 2], [1, 1, 1, 9], list(range(101)), [3, 3, 3]])
def test_quantiles(spark, values):
    counts = spark.createDataFrame([("g", v) for v in values], "k string, v bigint").groupBy("k", "v").agg(F.count("*").alias("n"))
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = quantiles_from_counts(counts, ["k"], "v", "n", wanted).first()
    for name, p in wanted.items():
        assert got[name] == pytest.approx(np.percentile(values, p * 100))


def test_service_map_defaults_to_last_hour(spark):
    df = spans(spark, span("t", "s", service="a", start=-30), span("t", "old", service="b", start=-7200))
    found, _ = service_map.service_map(df, end=at(0))
    assert rows(found, "name") == [("a",)]


def test_query_spans_filters_and_order(spark):
    df = spans(
        spark, span("t", "1", start=1, ms=5), span("t", "2", start=2, ms=50, status=2), span("t", "3", start=3, ms=500),
        span("t", "4", start=100, attributes={"k": "v"}),
    )
    assert rows(ops.query_spans(df, at(1), at(3)), "span_id") == [("3",), ("2",), ("1",)]
    assert rows(ops.query_spans(df, at(1), at(3), limit=1), "span_id") == [("3",)]
    assert rows(ops.query_spans(df, at(0), at(200), min_duration_ms=50, max_duration_ms=50), "span_id") == [("2",)]
    assert rows(ops.query_spans(df, at(0), at(200), status=0, tags={"k": "v"}), "span_id") == [("4",)]
    assert rows(ops.query_spans(df, at(0), at(200), service="nope")) == []
    assert rows(ops.query_spans(df, at(0), at(200), operation="op", limit=-3), "span_id")[0] == ("4",)


def test_get_trace(spark):
    df = spans(
        spark, span("x", "span-root", service="front", ms=50, status=1),
        span("x", "span-db", "span-root", "db", 25, status=1, start=0.005), span("y", "other", start=1),
    )
    header, found = ops.get_trace(df, "x")
    head = header.first()
    assert head["span_count"] == 2 and not head["has_error"] and head["duration_ms"] == 50
    assert head["services"] == ["db", "front"] and head["root"]["span_id"] == "span-root"
    assert rows(found, "span_id") == [("span-root",), ("span-db",)]
    with pytest.raises(LookupError):
        ops.get_trace(df, "missing")


def test_last_root_counts_and_no_root_is_null(spark):
    df = spans(spark, span("a", "1"), span("a", "2", start=1), span("b", "3", "gone"))
    got = dict(rows(ops.assemble_traces(df), "trace_id", "root.span_id"))
    assert got == {"a": "2", "b": None}


def test_timeline_is_sorted(spark):
    df = spans(spark, span("b", "1", start=2), span("a", "3", start=1), span("a", "2", start=1), span("a", "4", start=0))
    assert rows(ops.trace_timeline(df), "trace_id", "span_id") == [("a", "4"), ("a", "2"), ("a", "3"), ("b", "1")]


def test_summaries_ties_and_searches(spark):
    df = spans(
        spark,
        span("a", "2", service="late-id", start=0), span("a", "1", service="first", start=0, operation_name="first-op"),
        span("a", "3", "1", "third", start=1, ms=2000, status=2, attributes={"k": "v"}),
        span("b", "4", service="other", start=5),
    )
    got = {r["trace_id"]: r for r in ops.trace_summaries(df, at(0), at(10)).collect()}
    a = got["a"]
    assert (a["root_service"], a["root_operation"], a["span_count"], a["service_count"]) == ("first", "first-op", 3, 3)
    assert a["error_count"] == 1 and a["has_error"] and a["duration_ms"] == 3000
    assert rows(ops.trace_summaries(df, at(0), at(10)), "trace_id") == [("b",), ("a",)]
    # The hit is on a span that is not the root, and must be one span passing all filters.
    hit = ops.search_traces(df, at(0), at(10), service="third", status=2, tags={"k": "v"})
    assert rows(hit, "trace_id", "span_count") == [("a", 3)]
    assert rows(ops.search_traces(df, at(0), at(10), service="first", status=2)) == []


def test_wide_range_has_no_duplicates(spark):
    # Spans on both sides of a six-hour edge of the range.
    df = spans(spark, span("a", "1", start=6 * 3600 - 1), span("a", "2", "1", start=6 * 3600 + 1))
    assert rows(ops.search_traces(df, at(0), at(24 * 3600)), "trace_id", "span_count") == [("a", 2)]


def test_incremental_equals_direct(spark):
    data = [span(f"t{i % 7}", str(i), "" if i < 7 else "0", f"s{i % 3}", ms=i, start=i * 9000, status=i % 3) for i in range(60)]
    df = spans(spark, *data)
    direct = ops.summaries_from_states(ops.trace_states(df))
    merged = ops.summaries_from_states(ops.merge_trace_states(ops.daily_trace_states(df)))
    assert sorted(rows(direct)) == sorted(rows(merged))


def test_slow_spans_and_error_patterns(spark):
    df = spans(
        spark, span("t", "1", ms=999), span("t", "2", ms=1000), span("t", "3", ms=5000),
        span("t", "4", status=2, status_message="old", start=1), span("t", "5", status=2, status_message="new", start=2),
        span("t", "6", service="z", status=2, status_message="z"),
    )
    assert rows(analysis.slow_spans(df), "span_id") == [("3",), ("2",)]
    assert rows(analysis.error_patterns(df)) == [("svc", "op", 2, "new"), ("z", "op", 1, "z")]


def test_latency_anomalies(spark):
    def batch(start, service, ms):
        return [span("t", f"{service}{start}", service=service, ms=ms, start=start)]

    df = spans(
        spark, *batch(0, "up", 100), *batch(100, "up", 180), *batch(0, "same", 10), *batch(100, "same", 10),
        *batch(0, "zero", 0), *batch(100, "zero", 50), *batch(100, "new", 9),
    )
    got = rows(analysis.latency_anomalies(df, (at(0), at(50)), (at(100), at(150)), 50.0))
    assert [(g[0], *g[2:]) for g in got] == [("up", 100.0, 180.0, pytest.approx(80.0))]


def test_dependency_changes(spark):
    def call(trace, start, source, target):
        return [span(trace, "p", service=source, start=start), span(trace, "c", "p", target, start=start)]

    df = spans(spark, *call("1", 0, "a", "b"), *call("2", 0, "a", "c"), *call("3", 100, "a", "b"), *call("4", 100, "b", "d"))
    got = rows(analysis.dependency_changes(df, (at(0), at(50)), (at(100), at(150))))
    assert got == [("a", "c", "removed"), ("b", "d", "added")]
    report = analysis.analysis_report(df, at(100), at(150), (at(0), at(50)))
    assert set(report) == {"slow_spans", "error_patterns", "latency_anomalies", "service_changes"}
    assert report["service_changes"].count() == 2
