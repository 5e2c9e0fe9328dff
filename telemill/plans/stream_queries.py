"""Registered queries that write the given tables through files and streams and read the result back.

Each runs to the end of the given data with the available-now trigger.  Files and checkpoints go to the
folder the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemill.functions.timegrid import prune_days
from telemill.operators import logs as log_ops, spans as span_ops
from telemill.operators.alerts import alert_transitions, current_silences, route, unsilenced
from telemill.plans import alert_queries, metric_queries, trace_queries, views
from telemill.plans.log_queries import USER_ID_SQL
from telemill.plans.views import LOGS_SQL, SPANS_SQL
from telemill.schemas import SPAN_SCHEMA
from telemill.session import prepare_session, shared_dir
from telemill.sources import tables, topics
from telemill.sources.tables import fan_out
from telemill.streaming import alerting, windows

DELAY = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare_session(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, base: str) -> None:
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain(stream: DataFrame, purpose: str, base: str | None = None) -> DataFrame:
    """Run a stream over all available data into a Parquet folder; the rows written."""
    base = base or shared_dir(stream.sparkSession, purpose)
    _run(stream, base)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")


def drain_closed(
    source: DataFrame, plan: Callable[[DataFrame], DataFrame], purpose: str, time_column: str, base: str | None = None, **values
) -> DataFrame:
    """Run ``plan`` over all data of ``source``, end its input and run on until every window has closed."""
    spark = source.sparkSession
    base = base or shared_dir(spark, purpose)
    _run(plan(windows.with_closing(source, f"{base}/end")), base)
    windows.close_stream(spark, source.schema, f"{base}/end", time_column, **values)
    result = plan(windows.with_closing(source, f"{base}/end"))
    _run(result, base)
    return spark.read.schema(result.schema).parquet(f"{base}/rows")


def stream_multi_window(spark, sf_dir):
    points = views.event_metrics_of(event_stream(spark, sf_dir))
    closed = drain_closed(points, lambda p: windows.stream_multi_window(p, DELAY), "windows", "timestamp")
    return metric_queries.window_columns(closed)


STREAM_MULTI_WINDOW = metric_queries.window_sql(where="name <> 'item_price'")


def stream_window_cascade(spark, sf_dir):
    """Minutes from the raw stream into a table; hours and days from a stream over that table, a file at a time.

    The stream leaves a file per state partition and batch; reading packs many of them into a task, and a file per task
    is what the second stream goes through.
    """
    points = views.event_metrics_of(event_stream(spark, sf_dir))
    base = shared_dir(spark, "minutes")
    minutes = drain_closed(points, lambda p: windows.stream_multi_window(p, DELAY, {"1m": 60}), "minutes", "timestamp", base)
    minutes.write.parquet(f"{base}/packed")
    again = spark.readStream.schema(minutes.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/packed")
    write = windows.coarser_window_writer(f"{base}/states", {"5m": 300, "1h": 3600, "1d": 86400})
    query = again.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/coarser").trigger(availableNow=True).start()
    query.awaitTermination()
    coarser = windows.read_coarser_windows(spark.read.parquet(f"{base}/states"))
    return metric_queries.window_columns(minutes.unionByName(coarser))


STREAM_WINDOW_CASCADE = STREAM_MULTI_WINDOW


def stream_severity_counts(spark, sf_dir):
    logs = views.logs_of(event_stream(spark, sf_dir)).select("timestamp", "service_name", "severity")
    counts = drain_closed(logs, lambda rows: windows.stream_severity_counts(rows, DELAY), "severity", "timestamp")
    return counts.select(
        "service_name", F.col("severity").cast("bigint").alias("severity"), F.unix_micros("bucket").alias("bucket_us"), "cnt"
    )


STREAM_SEVERITY_COUNTS = f"""WITH logs_v AS ({LOGS_SQL})
SELECT service_name, CAST(severity AS BIGINT) AS severity, epoch_us(date_trunc('minute', "timestamp")) AS bucket_us, count(*) AS cnt
FROM logs_v GROUP BY 1, 2, 3"""


def stream_log_fields(spark, sf_dir):
    """The log stream's steps on a stream."""
    done = log_ops.process_logs(views.logs_of(event_stream(spark, sf_dir)))
    return drain(done, "logs").select(
        "span_id", "service_name", F.coalesce(F.col("structured_fields")["user_id"], F.lit("")).alias("user_id")
    )


STREAM_LOG_FIELDS = f"""WITH logs_v AS ({LOGS_SQL})
SELECT span_id, CASE WHEN service_name = '' THEN resource_service ELSE service_name END AS service_name,
  {USER_ID_SQL.format("body")} FROM logs_v WHERE severity > 5"""


def stream_trace_summaries(spark, sf_dir):
    """Trace states appended per micro-batch beside the span table, merged when read."""
    base = shared_dir(spark, "traces")
    spans = views.spans_of(event_stream(spark, sf_dir))
    states = windows.trace_state_writer(f"{base}/states")
    query = (
        spans.writeStream.foreachBatch(states)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    merged = span_ops.merge_trace_states(spark.read.parquet(f"{base}/states"))
    return trace_queries.summary_columns(span_ops.summaries_from_states(merged))


def stream_alert_transitions(spark, sf_dir):
    """Evaluations of the batch plan, dealt over files in no order of time, streamed through the alert states."""
    base = shared_dir(spark, "evaluations")
    columns = ["fingerprint", "rule_name", "tick_us", "firing", "duration_s", "value"]
    evaluated = alert_queries.evaluations(spark, sf_dir).select(columns)
    evaluated.repartition(6, F.xxhash64("tick_us")).write.parquet(base)
    stream = spark.readStream.schema(evaluated.schema).option("maxFilesPerTrigger", 2).parquet(base)
    # Ticks of the whole month may come from the last file, so that is how long the watermark waits.
    plan = lambda rows: alerting.stream_alert_transitions(rows, "31 days")
    with alerting.timer_store(spark):
        moved = drain_closed(stream, plan, "transitions", "tick_us", fingerprint="", firing=False, duration_s=0, value=0.0)
    return moved.select(
        "fingerprint", "rule_name", "tick_us", "state", "starts_us", "ends_us", F.round("value", 4).alias("value")
    )


def stream_sent(spark, sf_dir):
    """Candidate notifications of the batch plan, streamed through repeat suppression."""
    base = shared_dir(spark, "candidates")
    moved = alert_transitions(alert_queries.states(spark, sf_dir))
    silences = current_silences(alert_queries.silence_changes(spark))
    candidates = route(unsilenced(moved, silences), alert_queries.channels(spark))
    narrow = candidates.select("fingerprint", "channel", "state", "tick_us", "repeat_interval_s")
    narrow.write.parquet(base)
    stream = spark.readStream.schema(narrow.schema).parquet(base)
    plan = lambda rows: alerting.stream_suppress_repeats(rows, "31 days")
    with alerting.timer_store(spark):
        return drain_closed(stream, plan, "sent", "tick_us", fingerprint="", channel="", state="", repeat_interval_s=0)


def stored_spans(spark, sf_dir):
    """Spans handed to two writers, a table by day and a topic file; three days of the table read back."""
    base = shared_dir(spark, "spans")
    events = F.array(
        F.struct(F.col("start_time").alias("timestamp"), F.col("operation_name").alias("name"), "attributes")
    )
    spans = views.spans(spark, sf_dir).withColumn("events", events)
    spans = spans.withColumn("links", F.lit(None).cast(SPAN_SCHEMA["links"].dataType))
    fan_out(
        [
            lambda batch, _: tables.write_spans(batch, f"{base}/spans"),
            lambda batch, _: topics.encode(batch, topics.TOPIC_KEYS["spans"]).write.parquet(f"{base}/topic"),
        ]
    )(spans, 0)
    found = prune_days(
        tables.read_spans(spark, f"{base}/spans"), "start_time", "2024-01-10", "2024-01-12 23:59:59.999999"
    )
    sent = spark.read.parquet(f"{base}/topic").select(F.col("key").alias("trace_id")).distinct()
    return found.join(sent, "trace_id", "left_semi").select(
        "trace_id", "span_id", "service_name", F.unix_micros("start_time").alias("start_us"), "duration_ms",
        F.unix_micros(F.col("events")[0]["timestamp"]).alias("event_us"),
        F.col("events")[0]["attributes"]["props"].alias("event_props"),
        F.col("_date").cast("string").alias("day"),
    )


STORED_SPANS = f"""WITH spans_v AS ({SPANS_SQL})
SELECT trace_id, span_id, service_name, epoch_us(start_time) AS start_us, duration_ms, epoch_us(start_time) AS event_us,
  attr_props AS event_props, strftime(start_time, '%Y-%m-%d') AS day
FROM spans_v WHERE start_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:59:59.999999'"""


def _alert_sql(name: str) -> str:
    return alert_queries.QUERIES[name][1]


QUERIES = {
    "stream_multi_window": (stream_multi_window, STREAM_MULTI_WINDOW),
    "stream_window_cascade": (stream_window_cascade, STREAM_WINDOW_CASCADE),
    "stream_severity_counts": (stream_severity_counts, STREAM_SEVERITY_COUNTS),
    "stream_log_fields": (stream_log_fields, STREAM_LOG_FIELDS),
    "stream_trace_summaries": (stream_trace_summaries, trace_queries.INCREMENTAL_SUMMARIES),
    "stream_alert_transitions": (stream_alert_transitions, _alert_sql("alert_transitions")),
    "stream_sent": (
        stream_sent,
        f"{alert_queries.BASE_SQL} SELECT fingerprint, channel, state, tick_us FROM fold WHERE sent",
    ),
    "stored_spans": (stored_spans, STORED_SPANS),
}
