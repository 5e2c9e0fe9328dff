"""Trace analysis: slow spans, error patterns, latency anomalies, dependency changes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from telemill.functions.fields import has_error
from telemill.functions.quantiles import quantiles_from_counts
from telemill.functions.timegrid import micros, prune_days, within
from telemill.operators.service_map import calls, duration_counts, latency_quantiles

SLOW_SPAN_MS = 1000


def slow_spans(spans: DataFrame, threshold_ms: int = SLOW_SPAN_MS) -> DataFrame:
    """Spans of at least ``threshold_ms``, slowest first."""
    return (
        spans.filter(F.col("duration_ms") >= threshold_ms)
        .select("trace_id", "span_id", "service_name", "operation_name", "duration_ms", "start_time")
        .orderBy(F.desc("duration_ms"), "start_time", "span_id")
        .drop("start_time")
    )


def error_patterns(spans: DataFrame) -> DataFrame:
    """Errors per (service, operation) with the message of the newest one, most frequent first."""
    return (
        spans.filter(has_error())
        .groupBy("service_name", "operation_name")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.max(F.struct("start_time", "span_id", "status_message")).alias("newest"),
        )
        .select("service_name", "operation_name", "count", F.col("newest.status_message").alias("sample"))
        .orderBy(F.desc("count"), "service_name", "operation_name")
    )


def p99_by_operation(spans: DataFrame) -> DataFrame:
    return latency_quantiles(spans, ["service_name", "operation_name"], {"p99_ms": 0.99})


def in_windows(spans: DataFrame, windows: Mapping[str, tuple]) -> DataFrame:
    """Spans labelled with the windows they start in, from one scan; overlapping windows share spans."""
    bounds = [(name, micros(start), micros(end)) for name, (start, end) in windows.items()]
    spanned = prune_days(spans, "start_time", min(b[1] for b in bounds), max(b[2] for b in bounds))
    labels = F.array_compact(
        F.array(*[F.when(within("start_time", start, end), F.lit(name)) for name, start, end in bounds])
    )
    return spanned.withColumn("period", F.explode(labels))


def latency_anomalies(spans: DataFrame, baseline: tuple, current: tuple, threshold_pct: float) -> DataFrame:
    """Operations whose p99 grew by more than ``threshold_pct`` percent over the baseline, worst first."""
    labelled = in_windows(spans, {"baseline": baseline, "current": current})
    keys = ["service_name", "operation_name"]
    p99 = quantiles_from_counts(
        duration_counts(labelled, *keys, "period"), [*keys, "period"], "duration_ms", "n", {"p99_ms": 0.99}
    )

    def of(period: str):
        return F.max(F.when(F.col("period") == period, F.col("p99_ms")))

    return (
        p99.groupBy(*keys)
        .agg(of("baseline").alias("baseline_p99_ms"), of("current").alias("current_p99_ms"))
        .withColumn(
            "deviation_pct",
            F.try_divide(F.col("current_p99_ms") - F.col("baseline_p99_ms"), F.col("baseline_p99_ms")) * 100,
        )
        .filter(F.col("deviation_pct") > threshold_pct)
        .orderBy(F.desc("deviation_pct"), *keys)
    )


def dependency_changes(spans: DataFrame, baseline: tuple, current: tuple) -> DataFrame:
    """Service calls seen only in the current window (added) or only in the baseline (removed).

    Both windows go through one join; the period is part of its key, so parents and children are
    matched inside their window only.
    """
    labelled = in_windows(spans, {"baseline": baseline, "current": current})
    return (
        calls(labelled, "period")
        .groupBy("source", "target")
        .agg(
            F.bool_or(F.col("period") == "baseline").alias("before"),
            F.bool_or(F.col("period") == "current").alias("after"),
        )
        .filter(F.col("before") != F.col("after"))
        .select("source", "target", F.when(F.col("after"), "added").otherwise("removed").alias("change_type"))
        .orderBy("source", "target")
    )


def analysis_report(
    spans: DataFrame, start, end, baseline: tuple, threshold_pct: float = 50.0
) -> dict[str, DataFrame]:
    """All analyses of one window against a baseline window."""
    window = prune_days(spans, "start_time", start, end)
    return {
        "slow_spans": slow_spans(window),
        "error_patterns": error_patterns(window),
        "latency_anomalies": latency_anomalies(spans, baseline, (start, end), threshold_pct),
        "service_changes": dependency_changes(spans, baseline, (start, end)),
    }
