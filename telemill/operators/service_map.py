"""Service dependency map: nodes, edges, latency quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from telemill.functions.fields import has_error, is_root, safe_div
from telemill.functions.quantiles import quantiles_from_counts
from telemill.functions.timegrid import MICROS, micros, prune_days


def window_seconds(start, end) -> float:
    """Length used for rates; an empty or negative window counts as one second."""
    seconds = (micros(end) - micros(start)) / MICROS
    return seconds if seconds > 0 else 1.0


def duration_counts(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans and errors per group and duration: all that rates and exact quantiles need."""
    return spans.groupBy(*keys, "duration_ms").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(has_error()).alias("n_errors")
    )


def service_nodes(spans: DataFrame, start, end) -> DataFrame:
    """Per service: span count, calls per second, error rate, p99; sorted by name."""
    counts = duration_counts(prune_days(spans, "start_time", start, end), "service_name")
    stats = quantiles_from_counts(
        counts, ["service_name"], "duration_ms", "n",
        {"p99_latency_ms": 0.99}, {"span_count": "n", "error_count": "n_errors"},
    )
    return stats.select(
        F.col("service_name").alias("name"),
        (F.col("span_count") / F.lit(window_seconds(start, end))).alias("call_rate"),
        safe_div(F.col("error_count"), F.col("span_count")).alias("error_rate"),
        "p99_latency_ms",
        "span_count",
    ).orderBy("name")


def calls(spans: DataFrame, *keys: str) -> DataFrame:
    """Calls between different services, counted per (keys, source, target, duration).

    A child is matched to its parent on (trace_id, span_id).  Both sides are reduced first, with
    map-side combine:

    * children of one parent collapse to their distinct (service, duration), so neither a parent with
      a large share of all spans nor repeated deliveries of a child make a join task grow with rows;
    * several rows with one span id collapse to the earliest, so they cannot multiply calls.  Grouped on
      the join key, that side needs no further shuffle.
    """
    on = [*keys, "trace_id"]
    children = duration_counts(
        spans.filter(~is_root()), *on, "parent_span_id", "service_name"
    ).withColumnRenamed("service_name", "target")
    parents = (
        spans.groupBy(*on, "span_id")
        .agg(F.min(F.struct("start_time", "service_name")).alias("earliest"))
        .select(*on, F.col("span_id").alias("parent_span_id"), F.col("earliest.service_name").alias("source"))
    )
    return (
        children.join(parents, [*on, "parent_span_id"])
        .filter(F.col("source") != F.col("target"))
        .groupBy(*keys, "source", "target", "duration_ms")
        .agg(F.sum("n").alias("n"), F.sum("n_errors").alias("n_errors"))
    )


def service_edges(spans: DataFrame, start, end) -> DataFrame:
    """Directed calls between services with rates and the latency quantiles of the called side."""
    stats = quantiles_from_counts(
        calls(prune_days(spans, "start_time", start, end)),
        ["source", "target"], "duration_ms", "n",
        {"p50_latency_ms": 0.50, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99},
        {"total_calls": "n", "error_calls": "n_errors"},
    )
    return stats.select(
        "source",
        "target",
        (F.col("total_calls") / F.lit(window_seconds(start, end))).alias("call_rate"),
        safe_div(F.col("error_calls"), F.col("total_calls")).alias("error_rate"),
        "p50_latency_ms",
        "p95_latency_ms",
        "p99_latency_ms",
        "total_calls",
        "error_calls",
    ).orderBy("source", "target")


def service_map(spans: DataFrame, start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a window; by default the last hour."""
    end_us = micros(end if end is not None else datetime.now(timezone.utc))
    start_us = micros(start) if start is not None else end_us - 3600 * MICROS
    return service_nodes(spans, start_us, end_us), service_edges(spans, start_us, end_us)


def latency_quantiles(spans: DataFrame, keys: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """Exact duration quantiles per group, by linear interpolation."""
    return quantiles_from_counts(duration_counts(spans, *keys), list(keys), "duration_ms", "n", quantiles)
