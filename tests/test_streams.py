"""Streams against their batch twins, late rows, restarts."""

import json
import os

import pytest
from conftest import at, log, point, points, rows, span, spans
from pyspark.sql import functions as F
from test_alerts import evaluations, random_runs

from telemill.operators import alerts, metrics as metric_ops, spans as span_ops
from telemill.operators.processors import normalize_services
from telemill.plans import stream_queries
from telemill.plans.ingest import ingest_stream
from telemill.schemas import METRIC_SCHEMA, SPAN_SCHEMA
from telemill.sources import topics
from telemill.streaming import alerting, windows


def run(stream, path, sink="rows"):
    query = (
        stream.writeStream.format("parquet").option("path", f"{path}/{sink}").option("checkpointLocation", f"{path}/checkpoint-{sink}")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def result(spark, stream, path, sink="rows"):
    return spark.read.schema(stream.schema).parquet(f"{path}/{sink}")


def window_rows(df):
    keys = ["name", "service_name", "labels", "window_size", "bucket", "sum", "count", "min", "max", "avg"]
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=str)


def test_windows_late_rows_and_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*batch):
        points(spark, *batch).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return windows.stream_multi_window(spark.readStream.schema(METRIC_SCHEMA).parquet(source), "2 minutes", {"1m": 60, "5m": 300})

    arrive(point("m", 1, 10, a="x"), point("m", 3, 50, a="x"), point("m", 9, 400, a="y"))
    first = stream()
    run(first, out)
    # The watermark stands at 400 - 120 = 280 s.  Late for the minute at 60 s, in time for the one at 300 s;
    # the five minutes from 0 s are still open for it.
    arrive(point("m", 100, 70, a="x"), point("m", 5, 310, a="x"))
    query = run(stream(), out)
    assert windows.late_rows(query) == 1
    arrive(point("m", 0, 4000, a="z"))
    run(stream(), out)
    got = window_rows(result(spark, first, out))
    kept = points(spark, point("m", 1, 10, a="x"), point("m", 3, 50, a="x"), point("m", 9, 400, a="y"), point("m", 5, 310, a="x"))
    late = points(spark, point("m", 100, 70, a="x"))
    want = window_rows(metric_ops.multi_window_aggregate(kept, {"1m": 60}))
    want += window_rows(metric_ops.multi_window_aggregate(kept.union(late), {"5m": 300}))
    assert got == sorted(want, key=str)


def test_log_topic_end_to_end(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def line(body, severity):
        row = log(body, severity)
        return json.dumps({**row, "timestamp": row["timestamp"].isoformat(), "observed_timestamp": None})

    (source / "a.txt").write_text("\n".join([line("GET /x", 9), line("debug", 5), "{damaged"]) + "\n")
    (source / "b.txt").write_text(line("user_id=7", 17) + "\n")
    from telemill.operators.logs import process_logs

    decoded = topics.decode_logs(topics.open_text_files(spark, str(source), max_files=1))
    stream = process_logs(decoded)
    run(stream, out)
    got = {r["body"]: r for r in result(spark, stream, out).collect()}
    assert set(got) == {"GET /x", "user_id=7"}
    assert got["user_id=7"]["structured_fields"] == {"user_id": "7"} and got["GET /x"]["observed_timestamp"] is not None


def test_ingest_stream_with_trace_states(spark, tmp_path):
    source = str(tmp_path / "in")
    data = [span(f"t{i % 5}", str(i), "" if i < 5 else "0", f"S_{i % 3}", ms=i, start=i, status=i % 3) for i in range(40)]
    spans(spark, *data[:20]).coalesce(1).write.parquet(source)
    spans(spark, *data[20:]).coalesce(1).write.mode("append").parquet(source)
    states = windows.trace_state_writer(str(tmp_path / "states"))
    stream = spark.readStream.schema(SPAN_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    batches = []
    query = ingest_stream(
        stream, [normalize_services], [lambda b, i: batches.append(b.count()), states],
        str(tmp_path / "checkpoint"), {"availableNow": True},
    ).start()
    query.awaitTermination()
    assert sorted(batches) == [20, 20]
    merged = span_ops.merge_trace_states(spark.read.parquet(str(tmp_path / "states")))
    direct = span_ops.trace_states(normalize_services(spans(spark, *data)))
    assert sorted(rows(span_ops.summaries_from_states(merged))) == sorted(rows(span_ops.summaries_from_states(direct)))
    # A batch that is delivered again replaces its own rows.
    states(normalize_services(spans(spark, *data[:20])), 0)
    assert len(os.listdir(tmp_path / "states")) == 2


BEGIN = 86400


@pytest.fixture
def timers(spark):
    with alerting.timer_store(spark):
        yield


def alert_stream(spark, schema, source, out, delay):
    return alerting.stream_alert_transitions(windows.with_closing(spark.readStream.schema(schema).parquet(source), f"{out}/end"), delay)


def state_rows(query):
    """Rows in the state store after each batch of a query's run."""
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


def test_alert_transitions_in_any_file_order_with_restarts(spark, tmp_path, timers):
    """Files hold ticks of all times; what the watermark has not passed waits, over restarts, too."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    evals = evaluations(spark, random_runs(11)).select("fingerprint", "rule_name", "tick_us", "firing", "duration_s", "value")
    evals = evals.withColumn("tick_us", evals.tick_us + 86400 * 1_000_000)  # the watermark begins at the epoch
    for part in (2, 0, 1):  # the latest ticks first
        evals.filter(f"pmod(tick_us div 30000000, 3) = {part}").coalesce(1).write.mode("append").parquet(source)
        stream = alert_stream(spark, evals.schema, source, out, "1 hour")
        run(stream, out)  # a new query each time: what waits comes back from the checkpoint
    assert result(spark, stream, out).count() == 0
    windows.close_stream(spark, evals.schema, f"{out}/end", "tick_us", fingerprint="", firing=False, duration_s=0, value=0.0)
    query = run(alert_stream(spark, evals.schema, source, out, "1 hour"), out)
    columns = ["fingerprint", "rule_name", "state", "tick_us", "starts_us", "ends_us", "value"]
    got = sorted(rows(result(spark, stream, out), *columns), key=str)
    want = sorted(rows(alerts.alert_transitions(alerts.alert_states(evals)), *columns), key=str)
    assert got == want and len(got) > 50
    # Nothing waits but the closing row, and only alerts that are under way have a state.
    open_alerts = {r[0] for r in want} - {fp for fp, state, tick in ((r[0], r[2], r[3]) for r in want) if state == "resolved" and tick == max(w[3] for w in want if w[0] == fp)}
    assert state_rows(query)[-1] <= 3 * (len(open_alerts) + 1)


def test_late_ticks_are_dropped_and_counted_and_state_leaves(spark, tmp_path, timers):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "fingerprint string, rule_name string, tick_us bigint, firing boolean, duration_s bigint, value double"

    def arrive(*ticks):
        spark.createDataFrame([(f, "r", (BEGIN + t) * 1_000_000, on, 0, float(t)) for f, t, on in ticks], schema).coalesce(1).write.mode("append").parquet(source)
        shape = spark.read.parquet(source).schema
        return run(alert_stream(spark, shape, source, out, "60 seconds"), out)

    arrive(("a", 0, True), ("a", 60, False), ("b", 30, True), ("c", 1000, False))
    query = arrive(("a", 30, True), ("c", 990, True), ("c", 2000, False))  # the first is late: the watermark stands at 940
    assert windows.late_rows(query) == 1
    got = sorted(rows(result(spark, alert_stream(spark, spark.read.parquet(source).schema, source, out, "60 seconds"), out), "fingerprint", "state", "tick_us"))
    assert [(f, s, t // 1_000_000 - BEGIN) for f, s, t in got] == [("a", "pending", 0), ("a", "resolved", 60), ("b", "pending", 30), ("c", "pending", 990), ("c", "resolved", 1000)]
    quiet = arrive(("c", 5000, False))
    # the state of b, and one waiting tick of c with its timer
    assert state_rows(quiet)[-1] < state_rows(query)[0] + 4


def test_repeat_suppression_with_restarts(spark, tmp_path, timers):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    candidates = spark.createDataFrame(
        [(f"f{k}", "c", "firing", (BEGIN + t * 70 + k) * 1_000_000, 300) for k in range(4) for t in range(50) if (t * 7 + k) % 3],
        "fingerprint string, channel string, state string, tick_us bigint, repeat_interval_s bigint",
    )

    def stream():
        return alerting.stream_suppress_repeats(windows.with_closing(spark.readStream.schema(candidates.schema).parquet(source), f"{out}/end"), "1 minute")

    for low, high in ((0, 1500), (1500, 9999)):
        candidates.filter(candidates.tick_us.between((BEGIN + low) * 1_000_000, (BEGIN + high) * 1_000_000 - 1)).write.mode("append").parquet(source)
        run(stream(), out)
    windows.close_stream(spark, candidates.schema, f"{out}/end", "tick_us", fingerprint="", channel="", state="", repeat_interval_s=0)
    query = run(stream(), out)
    columns = ["fingerprint", "channel", "state", "tick_us"]
    assert sorted(rows(result(spark, stream(), out), *columns)) == sorted(rows(alerts.suppress_repeats(candidates), *columns))
    assert state_rows(query)[-1] <= 3  # all intervals are over; the closing row waits


def test_severity_stream_equals_batch_on_closed_minutes(spark, tmp_path):
    from conftest import logs
    from telemill.operators.logs import severity_counts
    from telemill.schemas import LOG_SCHEMA

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = logs(spark, *[log(severity=9 + i % 2, seconds=i * 7, service=f"s{i % 2}") for i in range(100)])
    df.write.parquet(source)
    stream = windows.stream_severity_counts(spark.readStream.schema(LOG_SCHEMA).parquet(source), "1 minute")
    run(stream, out)
    columns = ["service_name", "severity", "bucket", "cnt"]
    closed = severity_counts(df).filter(f"bucket < timestamp'{at(600).replace(tzinfo=None).isoformat()}'")
    assert sorted(rows(result(spark, stream, out), *columns)) == sorted(rows(closed, *columns))


@pytest.mark.parametrize("files", [1, 2, 1000])
def test_cascade_loses_no_minute(spark, tmp_path, files):
    source, fine, out = str(tmp_path / "in"), str(tmp_path / "fine"), str(tmp_path / "out")
    data = [point("m", i % 17, i * 13, a=str(i % 2)) for i in range(200)]
    for part in (data[:90], data[90:150], data[150:]):
        points(spark, *part).coalesce(1).write.mode("append").parquet(source)
        minutes = windows.stream_multi_window(spark.readStream.schema(METRIC_SCHEMA).parquet(source), "1 minute", {"1m": 60})
        run(minutes, fine)
        # Minutes arrive in files of any time order; how many go into a batch does not matter.
        again = spark.readStream.schema(minutes.schema).option("maxFilesPerTrigger", files).parquet(f"{fine}/rows")
        write = windows.coarser_window_writer(f"{out}/states", {"5m": 300})
        query = again.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    got = window_rows(windows.read_coarser_windows(spark.read.parquet(f"{out}/states")))
    # The last point is at 2587 s, so minutes up to 2520 s are closed.
    closed = points(spark, *[p for p in data if p["timestamp"] < at(2520)])
    assert got == window_rows(metric_ops.multi_window_aggregate(closed, {"5m": 300})) and len(got) == 18


def test_the_cascade_goes_through_few_files(spark, tmp_path):
    """The second stream takes a batch per file, so state partitions must not set the number of batches."""
    ids = spark.range(1200)
    events = ids.select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"),
    )
    events.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        windows_of = rows(stream_queries.stream_window_cascade(spark, str(tmp_path)), "window_size", "count")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {s: sum(n for size, n in windows_of if size == s) for s in ("1m", "5m", "1h", "1d")} == dict.fromkeys(("1m", "5m", "1h", "1d"), 2400)
    (made,) = [f for f in set(os.listdir(shared)) - before if f.startswith("minutes-")]
    assert len(os.listdir(f"{shared}/{made}/states")) < 20
