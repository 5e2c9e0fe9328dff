"""Log search, trace context, severity counts, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telemill.functions.fields import (
    contains_ignoring_ascii_case,
    extract_body_fields,
    is_missing,
)
from telemill.functions.timegrid import MICROS, bucket_start, floor_div, long_lit, prune_days
from telemill.operators.joins import rows_of_keys
from telemill.operators.metrics import top

DEFAULT_LIMIT = 200
DROP_UP_TO_SEVERITY = 5


def log_condition(
    service: str | None = None,
    min_severity: int = 0,
    keyword: str | None = None,
    trace_id: str | None = None,
    span_id: str | None = None,
    severity: int | None = None,
    case_sensitive: bool = False,
) -> Column:
    """All the filters that are set, as one condition on a log row."""
    condition = F.lit(True)
    if service:
        condition &= F.col("service_name") == service
    if min_severity > 0:
        condition &= F.col("severity") >= min_severity
    if severity is not None:
        condition &= F.col("severity") == severity
    if trace_id:
        condition &= F.col("trace_id") == trace_id
    if span_id:
        condition &= F.col("span_id") == span_id
    if keyword:
        if case_sensitive:
            condition &= F.col("body").contains(keyword)
        else:
            condition &= contains_ignoring_ascii_case("body", keyword)
    return condition


def search_logs(logs: DataFrame, start, end, *, limit: int | None = DEFAULT_LIMIT, **filters) -> DataFrame:
    """Log records of ``[start, end]`` that pass the filters, newest first; no limit (None, 0) means all."""
    found = (
        prune_days(logs, "timestamp", start, end)
        .filter(log_condition(**filters))
        .orderBy(F.desc("timestamp"), F.desc("trace_id"), F.desc("span_id"))
    )
    return top(found, limit)


def keyword_search(logs: DataFrame, keyword: str, start, end, *, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Records whose body contains the keyword, ignoring ASCII case; newest first."""
    if not keyword:
        raise ValueError("keyword is required")
    return search_logs(logs, start, end, keyword=keyword, limit=limit)


def at_least_severity(
    logs: DataFrame, min_severity: int, start, end, *, service: str | None = None, limit: int | None = DEFAULT_LIMIT
) -> DataFrame:
    return search_logs(logs, start, end, min_severity=min_severity, service=service, limit=limit)


def log_context(logs: DataFrame, trace_id: str, start=None, end=None) -> DataFrame:
    """All log records of one trace, oldest first.  With the range in which it ran, only those days are read."""
    if not trace_id:
        raise ValueError("trace_id is required")
    if start is not None and end is not None:
        logs = prune_days(logs, "timestamp", start, end)
    return logs.filter(F.col("trace_id") == trace_id).orderBy("timestamp", "trace_id", "span_id")


def of_traces(logs: DataFrame, trace_ids: DataFrame) -> DataFrame:
    """Log records of the traces named in ``trace_ids``; repeats there do not matter."""
    return rows_of_keys(logs, trace_ids, "trace_id", ["span_id", "timestamp", "body"])


def log_contexts(logs: DataFrame, trace_ids: DataFrame) -> DataFrame:
    """Log records of many traces, in trace and time order."""
    return of_traces(logs, trace_ids).orderBy("trace_id", "timestamp", "span_id")


def nearby_logs(logs: DataFrame, traces: DataFrame, window_s: int = 300) -> DataFrame:
    """Log records of the services of a trace, up to ``window_s`` seconds around the trace's own records.

    ``traces`` names the traces in ``trace_id``.  Result rows carry the trace they are near to as
    ``context_trace_id``.  The time condition is turned into an equality on time slices (a trace covers
    a few), which spreads one busy service over its slices instead of joining it in one task.
    """
    width = max(window_s, 1) * MICROS
    own = of_traces(logs, traces)
    spans = (
        own.groupBy("trace_id", "service_name")
        .agg(F.min(F.unix_micros("timestamp")).alias("t0"), F.max(F.unix_micros("timestamp")).alias("t1"))
        .select(
            F.col("trace_id").alias("context_trace_id"),
            "service_name",
            (F.col("t0") - long_lit(width)).alias("from_us"),
            (F.col("t1") + long_lit(width)).alias("to_us"),
        )
        .withColumn(
            "slice", F.explode(F.sequence(floor_div(F.col("from_us"), width), floor_div(F.col("to_us"), width)))
        )
    )
    at = F.unix_micros("timestamp")
    return (
        logs.withColumn("slice", floor_div(at, width))
        .join(spans, ["service_name", "slice"])
        .filter(at.between(F.col("from_us"), F.col("to_us")))
        .drop("slice", "from_us", "to_us")
    )


def severity_counts(logs: DataFrame) -> DataFrame:
    """Records per service, severity and minute."""
    return logs.groupBy(
        "service_name", "severity", bucket_start(F.col("timestamp"), 60).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("cnt"))


def merge_severity_counts(counts: DataFrame) -> DataFrame:
    """Add up counts of several batches."""
    return counts.groupBy("service_name", "severity", "bucket").agg(F.sum("cnt").alias("cnt"))


def drop_low_severity(logs: DataFrame, up_to: int = DROP_UP_TO_SEVERITY) -> DataFrame:
    return logs.filter(F.col("severity") > up_to)


def enrich_logs(logs: DataFrame, now: Column | None = None) -> DataFrame:
    """Fill an empty service name from the resource, and a missing observation time with ``now``."""
    from_resource = F.coalesce(F.col("resource_attributes")["service.name"], F.lit(""))
    return logs.withColumn(
        "service_name", F.when(is_missing("service_name"), from_resource).otherwise(F.col("service_name"))
    ).withColumn(
        "observed_timestamp",
        F.coalesce("observed_timestamp", now if now is not None else F.current_timestamp()),
    )


def extract_fields(logs: DataFrame) -> DataFrame:
    return logs.withColumn("structured_fields", extract_body_fields("body"))


def process_logs(logs: DataFrame, now: Column | None = None) -> DataFrame:
    """What every record of the log stream goes through: severity filter, enrichment, extraction."""
    return extract_fields(enrich_logs(drop_low_severity(logs), now))
