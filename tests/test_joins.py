"""Membership tests and size checks under a dominating key."""

import random

from conftest import log, logs, rows, span, spans
from pyspark.sql import functions as F

from telemill.operators.joins import rows_of_keys, small_side
from telemill.operators.logs import log_contexts
from telemill.operators.processors import tail_sample


def test_small_side_is_broadcast_only_when_small(spark):
    df = spark.range(10)
    assert "broadcast" in small_side(df, 10)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in small_side(df, 9)._jdf.queryExecution().analyzed().toString()


def test_rows_of_keys_with_a_third_of_rows_in_one_key_and_copies(spark):
    rng = random.Random(2)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i // 2) for i in range(3000)]
    wanted = [("hot",)] * 500 + [("k1",), ("k2",), ("",), (None,), ("k2",)]
    left = spark.createDataFrame(data, "key string, v int")
    right = spark.createDataFrame(wanted, "key string")
    got = sorted(rows(rows_of_keys(left, right, "key", ["v"])))
    assert got == sorted(d for d in data if d[0] in ("hot", "k1", "k2"))
    # and the rows of the hot key do not meet in one task
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = rows_of_keys(left, right, "key", ["v"]).filter("key = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks > 3


def test_tail_sample_with_one_huge_trace(spark):
    data = [span("huge", f"h{i}", status=2 if i == 77 else 0) for i in range(400)]
    data += [span(f"t{i // 4}", f"s{i}", status=2 if i % 37 == 0 else 0) for i in range(800)]
    failed = {s["trace_id"] for s in data if s["status"] == 2}
    got = sorted(rows(tail_sample(spans(spark, *data), 0.0), "trace_id", "span_id"))
    assert got == sorted((s["trace_id"], s["span_id"]) for s in data if s["trace_id"] in failed)
    half = {t for (t,) in rows(tail_sample(spans(spark, *data), 0.5), "trace_id")}
    assert failed < half and len(half) < 201


def test_log_contexts_of_identical_records(spark):
    df = logs(spark, *[log("same", trace_id="t", span_id="1")] * 300, *[log(str(i), trace_id=f"u{i}") for i in range(600)])
    wanted = spark.createDataFrame([("t",), ("u7",)], "trace_id string")
    assert log_contexts(df, wanted).count() == 301
