"""Nested export requests, topics, tables."""

import json
from datetime import datetime

import pytest
from conftest import T0, at, frame, log, logs, point, points, rows, span, spans
from pyspark.sql import functions as F

from telemill.functions.timegrid import prune_days
from telemill.operators import spans as span_ops
from telemill.plans.ingest import ingest_batch, ingest_signals
from telemill.operators.processors import normalize_services
from telemill.schemas import LOG_SCHEMA, SPAN_SCHEMA
from telemill.sources import otlp, tables, topics

NS = int(T0.timestamp()) * 10**9


def attr(key, **value):
    return {"key": key, "value": value}


def messages(spark, *bodies):
    return spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b),) for b in bodies], "value string")


def test_traces(spark):
    request = {
        "resourceSpans": [
            {
                "resource": {"attributes": [attr("service.name", stringValue="front"), attr("host", stringValue="h")]},
                "scopeSpans": [
                    {
                        "scope": {"name": "lib"},
                        "spans": [
                            {
                                "traceId": "ABCDEF", "spanId": "01", "name": "GET /", "kind": 2, "traceState": "k=v",
                                "startTimeUnixNano": str(NS), "endTimeUnixNano": str(NS + 1_999_999),
                                "status": {"code": 2, "message": "boom"},
                                "attributes": [attr("n", intValue="5"), attr("b", boolValue=True), attr("d", doubleValue=1.5)],
                                "events": [{"timeUnixNano": str(NS + 1000), "name": "ev", "attributes": [attr("e", stringValue="1")]}],
                                "links": [{"traceId": "FF", "spanId": "0A"}],
                            },
                            {"traceId": "abcdef", "spanId": "02", "parentSpanId": "01", "name": "x"},
                        ],
                    },
                    {"spans": [{"traceId": "t3", "spanId": "03"}]},
                ],
            },
            {"scopeSpans": [{"spans": [{"traceId": "t4", "spanId": "04"}]}]},
        ]
    }
    df = otlp.flatten_otlp_traces(messages(spark, request, {"resourceSpans": []}, "{broken"))
    assert df.schema.fieldNames() == SPAN_SCHEMA.fieldNames()
    got = {r["span_id"]: r for r in df.collect()}
    assert set(got) == {"01", "02", "03", "04"}
    first = got["01"]
    assert (first["trace_id"], first["service_name"], first["duration_ms"], first["status"], first["kind"]) == ("abcdef", "front", 1, 2, 2)
    assert first["attributes"] == {"n": "5", "b": "true", "d": "1.5"} and first["status_message"] == "boom"
    assert first["resource_attributes"] == {"service.name": "front", "host": "h"} and first["trace_state"] == "k=v"
    assert first["events"][0]["name"] == "ev" and first["events"][0]["timestamp"] == at(0.000001).replace(tzinfo=None)
    assert first["links"][0]["trace_id"] == "ff" and first["end_time"] == at(0.001999).replace(tzinfo=None)
    assert got["02"]["parent_span_id"] == "01" and got["02"]["attributes"] is None and got["03"]["service_name"] == "front"
    assert got["04"]["service_name"] == "" and got["04"]["resource_attributes"] is None


def test_attribute_values(spark):
    values = {
        "text": ({"stringValue": "x"}, "x"),
        "empty": ({"stringValue": ""}, ""),
        "whole": ({"doubleValue": 3.0}, "3"),
        "list": ({"arrayValue": {"values": [{"stringValue": 'a"b'}, {"intValue": "2"}, {"boolValue": False}, {}]}}, '["a\\"b",2,false,null]'),
        "none": ({"arrayValue": {"values": []}}, "[]"),
        "map": ({"kvlistValue": {"values": [attr("z", intValue="1"), attr("a", stringValue="s")]}}, '{"a":"s","z":1}'),
        "bytes": ({"bytesValue": "AAE="}, "AAE="),
        "nothing": ({}, ""),
    }
    request = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"attributes": [{"key": k, "value": v} for k, (v, _) in values.items()]}]}]}]}
    got = otlp.flatten_otlp_logs(messages(spark, request)).first()["log_attributes"]
    assert got == {k: text for k, (_, text) in values.items()}


def test_repeated_keys_keep_the_last_value(spark):
    request = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"attributes": [attr("k", stringValue="1"), attr("j", stringValue="x"), attr("k", stringValue="2")]}]}]}]}
    assert otlp.flatten_otlp_logs(messages(spark, request)).first()["log_attributes"] == {"k": "2", "j": "x"}


def test_logs(spark):
    record = {
        "timeUnixNano": str(NS), "severityNumber": 17, "severityText": "ERROR", "body": {"kvlistValue": {"values": [attr("m", stringValue="x")]}},
        "traceId": "AA", "spanId": "BB", "flags": 1,
    }
    resource = {"attributes": [attr("service.name", stringValue="api")]}
    df = otlp.flatten_otlp_logs(messages(spark, {"resourceLogs": [{"resource": resource, "scopeLogs": [{"logRecords": [record]}]}]}))
    assert df.schema.fieldNames() == LOG_SCHEMA.fieldNames()
    got = df.first()
    assert (got["severity"], got["body"], got["service_name"], got["trace_id"], got["trace_flags"]) == (17, '{"m":"x"}', "api", "aa", 1)
    assert got["observed_timestamp"] is None and got["timestamp"] == T0.replace(tzinfo=None)


def test_metrics(spark):
    def number(**value):
        return {"timeUnixNano": str(NS), "attributes": [attr("a", stringValue="1")], **value}

    request = {
        "resourceMetrics": [
            {
                "resource": {"attributes": [attr("service.name", stringValue="api")]},
                "scopeMetrics": [
                    {
                        "metrics": [
                            {"name": "g", "unit": "s", "description": "d", "gauge": {"dataPoints": [number(asDouble=1.5), number(asInt="7")]}},
                            {"name": "s", "sum": {"dataPoints": [number(asInt="9")], "isMonotonic": True}},
                            {"name": "h", "histogram": {"dataPoints": [number(count="3", sum=4.5, bucketCounts=["1", "2"], explicitBounds=[0.5])]}},
                        ]
                    }
                ],
            }
        ]
    }
    df = messages(spark, request)
    got = sorted(rows(otlp.flatten_otlp_metrics(df), "name", "type", "value", "unit", "service_name"))
    assert got == [("g", 1, 1.5, "s", "api"), ("g", 1, 7.0, "s", "api"), ("s", 2, 9.0, "", "api")]
    hist = otlp.flatten_otlp_histograms(df).first()
    assert (hist["name"], hist["type"], hist["count"], hist["sum"], hist["bucket_counts"], hist["explicit_bounds"]) == ("h", 3, 3, 4.5, [1, 2], [0.5])
    assert hist["labels"] == {"a": "1"}


def test_decode_skips_bad_messages(spark):
    good = {
        "timestamp": "2024-01-01T12:00:00.123456789Z", "observed_timestamp": "0001-01-01T00:00:00Z", "severity": 9, "body": "hi",
        "service_name": "s", "resource_attributes": {"service.name": "r"},
    }
    df = messages(spark, good, "not json", '{"severity": "high"}', "[1, 2]", "")
    got = topics.decode_logs(df).collect()
    assert len(got) == 1 and got[0]["body"] == "hi" and got[0]["observed_timestamp"] is None
    assert got[0]["timestamp"] == datetime(2024, 1, 1, 12, 0, 0, 123456)
    assert topics.undecodable(df, LOG_SCHEMA).count() == 4


def test_encode_round_trip(spark):
    df = points(spark, point("m", 1.25, 0.000001, a="1"), point("n", 2, b="2"))
    sent = topics.encode(df, topics.TOPIC_KEYS["metrics"])
    assert sorted(rows(sent, "key")) == [("m",), ("n",)]
    assert sorted(rows(topics.decode_metrics(sent)), key=str) == sorted(rows(df), key=str)


def test_sample_export(spark):
    got = topics.sample_export(points(spark, point("m", 1.5, 0.0015, z="1", a="2"), point("n", 2))).collect()
    assert [(x["name"], x["value"]) for x in got[0]["labels"]] == [("__name__", "m"), ("a", "2"), ("z", "1")]
    assert got[0]["samples"][0]["timestamp"] == int(T0.timestamp()) * 1000 + 1 and got[0]["samples"][0]["value"] == 1.5
    assert len(got[1]["labels"]) == 1


def test_span_table(spark, tmp_path):
    events = [(at(0), "e", {"k": "v"})]
    df = spans(
        spark, *[span("t", str(i), start=i * 86400 / 2, events=events, links=[("x", "y", "", None)], service=f"s{i % 2}") for i in range(6)]
    )
    path = str(tmp_path / "spans")
    tables.write_spans(df, path)
    tables.write_spans(spans(spark, span("late", "9", start=3)), path, cluster=False)
    back = tables.read_spans(spark, path)
    assert back.count() == 7
    row = back.filter("span_id = '0'").first()
    assert row["events"][0]["attributes"] == {"k": "v"} and row["links"][0]["span_id"] == "y"
    assert str(row["_date"]) == "2024-01-01"
    found = span_ops.query_spans(back, at(86400 / 2), at(86400))
    assert rows(found, "span_id") == [("2",), ("1",)]
    plan = prune_days(back, "start_time", at(86400 / 2), at(86400))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_date" in plan and "PushedFilters: [IsNotNull(start_time)" in plan


def test_retention(spark, tmp_path):
    df = logs(spark, log("old", seconds=-8 * 86400), log("edge", seconds=-7 * 86400), log("kept", seconds=-7 * 86400 + 1), log("same-second", seconds=-7 * 86400 + 0.5))
    # Seconds are whole when rows expire: a row half a second younger than the limit goes with it.
    assert rows(tables.apply_retention(df, tables.LOGS, at(0)), "body") == [("kept",)]
    tables.write_logs(df, str(tmp_path / "logs"))
    tables.rewrite_retained(spark, str(tmp_path / "logs"), str(tmp_path / "kept"), tables.LOGS, at(0), 7)
    assert rows(tables.read_table(spark, str(tmp_path / "kept")), "body") == [("kept",)]


def test_fan_out_collects_errors(spark):
    written = []

    def fails(name):
        def write(batch, batch_id):
            raise OSError(name)

        return write

    write = tables.fan_out([fails("one"), lambda b, i: written.append((b.count(), i)), fails("two")])
    with pytest.raises(RuntimeError, match="one.*two"):
        write(spans(spark, span("t", "s")), 0)
    assert written == [(1, 0)]
    tables.fan_out([fails("never")])(spans(spark), 1)  # nothing to write, nobody called


def test_ingest_signals(spark):
    out = {}
    ingest_signals(
        {"spans": spans(spark, span("t", "s", service="A B")), "logs": logs(spark, log("x")), "metrics": points(spark, point("m", 1))},
        {"spans": [normalize_services], "logs": [lambda d: d.filter(F.lit(False))]},
        {s: [lambda b, _, s=s: out.__setitem__(s, rows(b, "service_name"))] for s in ("spans", "logs", "metrics")},
    )
    assert out == {"spans": [("a-b",)], "metrics": [("svc",)]}
    ingest_batch(frame(spark, LOG_SCHEMA, []), [], [lambda b, _: out.clear()])
    assert out


def test_batches_own_their_folders_and_are_compacted(spark, tmp_path):
    path = str(tmp_path / "spans")
    write = tables.batch_writer(path, tables.SPANS, tables.stored_form)
    first = spans(spark, span("t", "1", events=[(at(0), "e", None)]), span("t", "2", start=86400))
    write(first, 0)
    write(spans(spark, span("t", "3", start=1)), 1)
    write(first, 0)  # delivered again
    back = tables.read_spans(spark, path)
    assert sorted(rows(spark.read.parquet(path), "span_id", "batch")) == [("1", 0), ("2", 0), ("3", 1)]
    assert "batch" not in back.columns
    tables.rewrite_retained(spark, path, str(tmp_path / "kept"), tables.SPANS, at(7 * 86400 + 0.5), 7)
    kept = tables.read_spans(spark, str(tmp_path / "kept"))
    assert sorted(rows(kept, "span_id")) == [("2",), ("3",)] and "batch" not in kept.columns


def test_rejected_requests(spark):
    from telemill.sources import otlp

    df = spark.createDataFrame([(None,), ("{broken",), ("{}",), ('{"resourceSpans": []}',)], "value string")
    got = sorted(rows(otlp.rejected_requests(df, otlp.TRACES_REQUEST, "resourceSpans"), "reason"))
    assert got == [("no message",), ("no resourceSpans",), ("not JSON",)]
