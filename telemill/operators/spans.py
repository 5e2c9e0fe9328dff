"""Span search, trace assembly, trace summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from telemill.functions.fields import has_error, is_root
from telemill.functions.timegrid import prune_days
from telemill.operators.joins import rows_of_keys
from telemill.operators.metrics import top

DEFAULT_LIMIT = 100


def span_condition(
    service: str | None = None,
    operation: str | None = None,
    min_duration_ms: int = 0,
    max_duration_ms: int = 0,
    status: int | None = None,
    tags: Mapping[str, str] | None = None,
) -> Column:
    """All the filters that are set, as one condition on a span row."""
    condition = F.lit(True)
    if service:
        condition &= F.col("service_name") == service
    if operation:
        condition &= F.col("operation_name") == operation
    if min_duration_ms > 0:
        condition &= F.col("duration_ms") >= min_duration_ms
    if max_duration_ms > 0:
        condition &= F.col("duration_ms") <= max_duration_ms
    if status is not None:
        condition &= F.col("status") == status
    for key, value in (tags or {}).items():
        condition &= F.coalesce(F.col("attributes")[key], F.lit("")) == value
    return condition


def query_spans(spans: DataFrame, start, end, *, limit: int | None = DEFAULT_LIMIT, **filters) -> DataFrame:
    """Spans started in ``[start, end]`` that pass the filters, newest first; no limit (None, 0) means all."""
    found = (
        prune_days(spans, "start_time", start, end)
        .filter(span_condition(**filters))
        .orderBy(F.desc("start_time"), F.desc("trace_id"), F.desc("span_id"))
    )
    return top(found, limit)


def get_spans(spans: DataFrame, trace_id: str, start=None, end=None) -> DataFrame:
    """All spans of one trace, oldest first.  With the range in which it ran, only those days are read."""
    if start is not None and end is not None:
        spans = prune_days(spans, "start_time", start, end)
    return spans.filter(F.col("trace_id") == trace_id).orderBy("start_time", "span_id")


def trace_timeline(spans: DataFrame) -> DataFrame:
    """Spans of every trace in time order.

    A global sort: Spark range-partitions on the whole sort key, so one huge trace is cut into
    several ranges instead of landing in one task.
    """
    return spans.orderBy("trace_id", "start_time", "span_id")


def assemble_traces(spans: DataFrame) -> DataFrame:
    """One row per trace: counts, error flag, root span, bounds and distinct services.

    First per (trace, service), then per trace.  The first step combines on the map side, so a trace
    holding a large share of all spans arrives at the second one as one row per service.  The spans
    themselves stay rows (``trace_timeline``); they are never gathered into one value.  With several
    roots the last one in time order counts.
    """
    root = F.when(
        is_root(),
        F.struct("start_time", "span_id", "service_name", "operation_name", "duration_ms", "status"),
    )
    per_service = spans.groupBy("trace_id", "service_name").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.bool_or(has_error()).alias("has_error"),
        F.max(root).alias("root"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
    )
    return (
        per_service.groupBy("trace_id")
        .agg(
            F.sum("span_count").alias("span_count"),
            F.bool_or("has_error").alias("has_error"),
            F.max("root").alias("root"),
            F.min("start_time").alias("start_time"),
            F.max("end_time").alias("end_time"),
            F.sort_array(F.collect_list("service_name")).alias("services"),
        )
        .withColumn("duration_ms", _elapsed_ms("start_time", "end_time"))
    )


def get_trace(spans: DataFrame, trace_id: str) -> tuple[DataFrame, DataFrame]:
    """One trace: its header row and its spans in time order; raises LookupError when it has none."""
    found = get_spans(spans, trace_id)
    if found.isEmpty():
        raise LookupError(f"trace {trace_id} not found")
    return assemble_traces(found), found


def _elapsed_ms(start: str, end: str) -> Column:
    return F.call_function("div", F.unix_micros(end) - F.unix_micros(start), F.lit(1000))


# -- summaries ----------------------------------------------------------------------------------


def trace_states(spans: DataFrame, *extra_keys: str) -> DataFrame:
    """Mergeable summary states per (trace, service): merge them with :func:`merge_trace_states`.

    Keeping the service in the key makes the distinct service count a row count, so no state holds a
    set.
    """
    return spans.groupBy("trace_id", "service_name", *extra_keys).agg(
        F.min(F.struct("start_time", "span_id", "operation_name")).alias("first_span"),
        F.max("end_time").alias("trace_end"),
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(has_error()).alias("error_count"),
    )


def merge_trace_states(states: DataFrame) -> DataFrame:
    """Merge states of any number of batches or days into one per (trace, service)."""
    return states.groupBy("trace_id", "service_name").agg(
        F.min("first_span").alias("first_span"),
        F.max("trace_end").alias("trace_end"),
        F.sum("span_count").alias("span_count"),
        F.sum("error_count").alias("error_count"),
    )


def summaries_from_states(states: DataFrame) -> DataFrame:
    """Trace summaries from merged states.  Root service and operation are those of the earliest span."""
    first = F.struct(
        F.col("first_span.start_time"), F.col("first_span.span_id"), "service_name", F.col("first_span.operation_name")
    )
    return (
        states.groupBy("trace_id")
        .agg(
            F.min(first).alias("first"),
            F.max("trace_end").alias("trace_end"),
            F.sum("span_count").alias("span_count"),
            F.sum("error_count").alias("error_count"),
            F.count(F.lit(1)).alias("service_count"),
        )
        .select(
            "trace_id",
            F.col("first.service_name").alias("root_service"),
            F.col("first.operation_name").alias("root_operation"),
            F.col("first.start_time").alias("trace_start"),
            F.call_function(
                "div", F.unix_micros("trace_end") - F.unix_micros("first.start_time"), F.lit(1000)
            ).alias("duration_ms"),
            "span_count",
            "error_count",
            "service_count",
            (F.col("error_count") > 0).alias("has_error"),
        )
    )


def _newest_summaries(spans: DataFrame, limit: int | None, hit: Column | None = None) -> DataFrame:
    """Summaries of the ``limit`` traces that start last, among those with a span passing ``hit``.

    With a filter, it runs at the scan, and only the ids of its hits are distinct and shuffled; starts are then
    looked up for those traces alone.  Without one, the start of every trace is: two narrow columns, aggregated
    in hash tables.  Then the summaries of the few traces that made it, whose spans are picked out of another
    scan by their ids, which AQE broadcasts if they are few.  No wide state is built or shuffled for traces that
    are not shown.
    """
    spread = ["span_id", "start_time"]
    starts = spans if hit is None else rows_of_keys(spans, spans.filter(hit), "trace_id", spread)
    if limit and limit > 0:
        newest = (
            starts.groupBy("trace_id")
            .agg(F.min("start_time").alias("trace_start"))
            .orderBy(F.desc("trace_start"), F.desc("trace_id"))
            .limit(limit)
        )
        starts = rows_of_keys(spans, newest, "trace_id", spread)
    shown = starts
    return summaries_from_states(trace_states(shown)).orderBy(F.desc("trace_start"), F.desc("trace_id"))


def trace_summaries(spans: DataFrame, start, end, *, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Summaries of the traces with spans started in ``[start, end]``, newest first; no limit (None, 0) means all."""
    return _newest_summaries(prune_days(spans, "start_time", start, end), limit)


def search_traces(spans: DataFrame, start, end, *, limit: int | None = DEFAULT_LIMIT, **filters) -> DataFrame:
    """Summaries of the traces in which any one span passes all filters, newest first; no limit (None, 0) means all.

    The summary covers all spans of the trace inside the range.  A range of any width is one plan: day
    partitions are pruned and read in parallel, and a trace crossing a day appears once.
    """
    hit = span_condition(**filters) if any(v not in (None, "", 0, {}) or v == 0 and k == "status" for k, v in filters.items()) else None
    return _newest_summaries(prune_days(spans, "start_time", start, end), limit, hit)


def daily_trace_states(spans: DataFrame) -> DataFrame:
    """States per day of span start: the table an incremental summary job appends to and merges."""
    return trace_states(spans.withColumn("day", F.to_date("start_time")), "day")

