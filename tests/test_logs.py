"""Log search, context, counts, enrichment."""

import pytest
from conftest import at, log, logs, rows, spans
from pyspark.sql import functions as F

from telemill.operators import logs as ops


def test_search(spark):
    df = logs(spark, log("user login successful", 9), log("database connection failed", 17, seconds=0.001))
    found = ops.search_logs(df, at(-60), at(60), service="svc", limit=10)
    assert rows(found, "severity") == [(17,), (9,)]
    assert rows(ops.search_logs(df, at(-60), at(60), min_severity=17), "severity") == [(17,)]
    assert rows(ops.search_logs(df, at(-60), at(60), severity=9), "severity") == [(9,)]
    assert ops.search_logs(df, at(1), at(60)).count() == 0
    assert ops.search_logs(df, at(0), at(0)).count() == 1


def test_search_by_trace_and_span(spark):
    df = logs(spark, log("a", trace_id="t", span_id="1"), log("b", trace_id="t", span_id="2"), log("c"))
    assert sorted(rows(ops.search_logs(df, at(0), at(0), trace_id="t"), "body")) == [("a",), ("b",)]
    assert rows(ops.search_logs(df, at(0), at(0), trace_id="t", span_id="2"), "body") == [("b",)]


def test_limit_defaults(spark):
    df = logs(spark, *[log(str(i), seconds=i) for i in range(230)])
    assert ops.search_logs(df, at(0), at(1000)).count() == 200
    assert ops.search_logs(df, at(0), at(1000), limit=-1).count() == df.count()


@pytest.mark.parametrize(
    "body, keyword, found",
    [
        ("Connection FAILED", "failed", True),
        ("Connection failed", "FAILED", True),
        ("für", "FüR", True),
        ("für", "FÜR", False),
        ("Ünder", "ünder", False),
        ("100% sure", "0% S", True),
        ("1000 sure", "0% s", False),
        ("a_b", "A_B", True),
        ("axb", "a_b", False),
        ("a.b [c] (d) \\E $", "A.B [C] (D) \\e $", True),
        ("axb", "a.b", False),
        ("12:30", "2:3", True),
    ],
)
def test_keyword_is_literal_and_folds_ascii_only(spark, body, keyword, found):
    df = logs(spark, log(body))
    assert ops.keyword_search(df, keyword, at(0), at(0)).count() == found


def test_empty_keyword_and_trace_are_errors(spark):
    with pytest.raises(ValueError):
        ops.keyword_search(logs(spark), "", at(0), at(1))
    with pytest.raises(ValueError):
        ops.log_context(logs(spark), "")


def test_log_context(spark):
    df = logs(spark, log("2", seconds=2, trace_id="t"), log("1", seconds=1, trace_id="t"), log("x", trace_id="u"), log("y"))
    assert rows(ops.log_context(df, "t"), "body") == [("1",), ("2",)]
    wanted = spark.createDataFrame([("t",), ("t",), ("",)], "trace_id string")
    assert rows(ops.log_contexts(df, wanted), "body") == [("1",), ("2",)]


def test_nearby_logs_against_brute_force(spark):
    data = [
        log(str(i), service=f"s{i % 3}", seconds=(i * 37) % 4000, trace_id="t" if i in (5, 50) else "u" if i == 70 else "")
        for i in range(200)
    ]
    df = logs(spark, *data)
    traces = spark.createDataFrame([("t",), ("u",)], "trace_id string")
    got = sorted(rows(ops.nearby_logs(df, traces, 300), "context_trace_id", "body"))
    want = set()
    for trace in ("t", "u"):
        for service in {d["service_name"] for d in data if d["trace_id"] == trace}:
            own = [d["timestamp"] for d in data if d["trace_id"] == trace and d["service_name"] == service]
            for d in data:
                near = (min(own) - d["timestamp"]).total_seconds() <= 300 and (d["timestamp"] - max(own)).total_seconds() <= 300
                if d["service_name"] == service and near:
                    want.add((trace, d["body"]))
    assert got == sorted(want) and len(got) > 10


def test_severity_counts_merge(spark):
    data = [log(severity=9 + i % 2, seconds=i) for i in range(150)]
    whole = ops.severity_counts(logs(spark, *data))
    parts = ops.severity_counts(logs(spark, *data[:70])).unionByName(ops.severity_counts(logs(spark, *data[70:])))
    assert sorted(rows(ops.merge_severity_counts(parts))) == sorted(rows(whole))
    assert sum(r[0] for r in rows(whole, "cnt")) == 150


def test_drop_low_severity_and_enrichment(spark):
    df = logs(spark, *[log(str(s), s) for s in (0, 1, 5, 6, 9)])
    assert rows(ops.drop_low_severity(df), "severity") == [(6,), (9,)]
    df = logs(
        spark, log("a", service="", resource_attributes={"service.name": "r"}), log("b", service=""),
        log("c", observed_timestamp=None), log("d", service=None, resource_attributes=None),
    )
    done = {r["body"]: r for r in ops.process_logs(df, F.timestamp_micros(F.lit(5))).collect()}
    assert [done[b]["service_name"] for b in "abcd"] == ["r", "", "svc", ""]
    assert done["c"]["observed_timestamp"].microsecond == 5 and done["a"]["observed_timestamp"].second == 0
    assert spans(spark).count() == 0
