"""Column functions and processors."""

import pytest
from conftest import log, logs, rows, span, spans
from pyspark.sql import functions as F

from telemill.functions import fields
from telemill.operators import processors
from telemill.operators.processors import AttributeRule, change_attributes, head_sample, tail_sample


def fnv(text: str) -> str:
    h = 0xCBF29CE484222325
    for byte in text.encode():
        h = ((h ^ byte) * 0x100000001B3) % 2**64
    return f"{h:x}"


def column(spark, kind, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def test_fnv_vectors(spark):
    texts = ["", "a", "foobar", "grüße ✓", "x" * 300, "a\nb\x00c\r\n", "\n", "日本語 😀"]
    # A text whose hash has leading zeros is written without them.
    short = next(t for t in (f"{i * i}-{i}" for i in range(100000)) if len(fnv(t)) < 15)
    df = column(spark, "string", *texts, short, None)
    assert rows(df, fields.fnv1a_hex("v")) == [(fnv(t),) for t in [*texts, short]] + [(None,)]
    assert fnv("") == "cbf29ce484222325" and fnv("foobar") == "85944171f73967e8"


def attributes(spark, attrs, *rules):
    return rows(change_attributes(spans(spark, span("t", "s", attributes=attrs)), rules), "attributes")[0][0]


@pytest.mark.parametrize(
    "attrs, rule, expected",
    [
        ({}, AttributeRule("add", "env", value="production"), {"env": "production"}),
        ({"env": "staging"}, AttributeRule("add", "env", value="production"), {"env": "staging"}),
        (None, AttributeRule("add", "env", value="production"), None),
        ({"sensitive": "x", "safe": "ok"}, AttributeRule("remove", "sensitive"), {"safe": "ok"}),
        ({"old_key": "value"}, AttributeRule("rename", "old_key", new_key="new_key"), {"new_key": "value"}),
        ({"a": "1", "b": "2"}, AttributeRule("rename", "a", new_key="b"), {"b": "1"}),
        ({"a": "1"}, AttributeRule("rename", "a", new_key="a"), {"a": "1"}),
        ({"b": "2"}, AttributeRule("rename", "a", new_key="b"), {"b": "2"}),
        ({"k": "foobar", "l": "x"}, AttributeRule("hash", "k"), {"k": "85944171f73967e8", "l": "x"}),
        ({"k": "foobar"}, AttributeRule("remove", "k", pattern="^bar"), {"k": "foobar"}),
        ({"k": "foobar"}, AttributeRule("remove", "k", pattern="bar$"), {}),
    ],
)
def test_attribute_rules(spark, attrs, rule, expected):
    assert attributes(spark, attrs, rule) == expected


def test_attribute_rules_run_in_order(spark):
    got = attributes(spark, {"a": "1"}, AttributeRule("rename", "a", new_key="b"), AttributeRule("add", "a", value="2"))
    assert got == {"a": "2", "b": "1"}
    with pytest.raises(ValueError):
        attributes(spark, {}, AttributeRule("upper", "a"))


def test_service_names(spark):
    df = column(spark, "string", "My_Service", "MyService/v2", "backend service", "already-normalized")
    expected = ["my-service", "myservice-v2", "backend-service", "already-normalized"]
    assert [r[0] for r in rows(df, fields.normalize_service_name("v"))] == expected


def test_severities(spark):
    df = column(spark, "string", "INFO", "info", "ERROR", "WARN", "WARNING", "DEBUG", "FATAL", "TRACE", "unknown", "Info")
    assert [r[0] for r in rows(df, fields.parse_severity("v"))] == [9, 9, 17, 13, 13, 5, 21, 1, 0, 0]
    df = column(spark, "int", 5, 9, 13, 17, 21, 0, 4, 24)
    assert [r[0] for r in rows(df, fields.is_error_log("v"))] == [False, False, False, True, True, False, False, True]
    names = ["DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNSPECIFIED", "TRACE", "FATAL"]
    assert [r[0] for r in rows(df, fields.severity_name("v"))] == names


def test_names_and_predicates(spark):
    df = column(spark, "int", 1, 2, 3, 4, 0, 5)
    assert [r[0] for r in rows(df, fields.metric_type_name("v"))][:5] == ["gauge", "counter", "histogram", "summary", "unspecified"]
    assert [r[0] for r in rows(df, fields.status_name("v"))] == ["ok", "error", "unset", "unset", "unset", "unset"]
    assert [r[0] for r in rows(df, fields.kind_name("v"))] == ["internal", "server", "client", "producer", "unspecified", "consumer"]
    df = spans(spark, span("t", "a", "", status=1), span("t", "b", "root", status=2))
    assert sorted(rows(df, "span_id", fields.is_root(), fields.has_error())) == [("a", True, False), ("b", False, True)]


def test_safe_div(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "a double, b double")
    assert rows(df, fields.safe_div(F.col("a"), F.col("b"))) == [(0.5,), (0.0,)]


@pytest.mark.parametrize(
    "body, expected",
    [
        ("GET /x HTTP/1.1 200 ok", {"http_method": "GET", "http_status": "200"}),
        ("post   /x", {"http_method": "post"}),
        ("java.lang.NullPointerException: at", {"error_type": "NullPointerException"}),
        ("TimeoutError: x duration=12.5ms user_id=77", {"error_type": "TimeoutError", "duration_ms": "12.5", "user_id": "77"}),
        ("duration: 3 ms, user id: 5", {"duration_ms": "3", "user_id": "5"}),
        ("xHTTP/1.1 200", {}),
        ("HTTP/1.1 2000", {}),
        ("nothing here", {}),
        ("", {}),
    ],
)
def test_body_fields(spark, body, expected):
    assert rows(logs(spark, log(body)), fields.extract_body_fields("body"))[0][0] == expected


def test_series_key_is_canonical(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1,=\\"},), ({"a": "1,=\\", "b": "2"},), ({},), (None,)], "labels map<string,string>")
    keys = [r[0] for r in rows(df, fields.series_key())]
    assert keys[0] == keys[1] and keys[2] == keys[3] == "{}" and keys[0] != keys[2]


def test_head_sample_keeps_errors_and_service_rates(spark):
    df = spans(spark, span("1", "1"), span("2", "2", status=2), span("3", "3"))
    assert rows(head_sample(df, 0.0), "span_id") == [("2",)]
    df = spans(spark, span("1", "1", service="critical-service"), span("2", "2", service="other-service"))
    assert rows(head_sample(df, 0.0, {"critical-service": 1.0}), "span_id") == [("1",)]
    assert head_sample(df, 1.0, {"critical-service": 0.0}).count() == 1


def test_head_sample_share_and_whole_traces(spark):
    df = spark.range(20000).select(
        F.concat(F.lit("t"), F.floor(F.col("id") / 4).cast("string")).alias("trace_id"), F.lit(0).alias("status"), F.lit("s").alias("service_name")
    )
    sizes = rows(head_sample(df, 0.3).groupBy("trace_id").count(), "count")
    assert {s for (s,) in sizes} == {4}
    assert 0.27 < len(sizes) / 5000 < 0.33


def test_tail_sample_keeps_failed_traces_whole(spark):
    df = spans(spark, span("a", "1"), span("a", "2", "1", status=2), span("b", "3"), span("b", "4", "3"))
    assert sorted(rows(tail_sample(df, 0.0), "span_id")) == [("1",), ("2",)]
    assert tail_sample(df, 1.0).count() == 4


def test_processors_run_in_order(spark):
    df = spans(spark, span("t", "s", service="A_B"))
    steps = [processors.normalize_services, lambda d: d.filter(F.col("service_name") == "a-b")]
    assert processors.run_processors(df, steps).count() == 1
    assert processors.run_processors(df, steps[::-1]).count() == 0
