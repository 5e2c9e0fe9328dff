"""Stored rollups of metric points and counts of log records, kept up as batches arrive."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from telemill.functions.timegrid import MICROS, micros
from telemill.operators import metrics
from telemill.operators.logs import merge_severity_counts, severity_counts
from telemill.schemas import DOUBLE, INT, LOG_SCHEMA, LONG, METRIC_SCHEMA, SPAN_SCHEMA, STR_MAP, TEXT
from telemill.sources.daytable import DayTable, MaintainedView
from telemill.sources.tables import LOGS, METRICS, SPANS, TableLayout

_KINDS = {"name": TEXT, "description": TEXT, "unit": TEXT, "type": INT, "labels": STR_MAP, "service_name": TEXT}
ROLLUP_SCHEMA = StructType(
    [StructField(k, _KINDS[k]) for k in metrics.ROLLUP_KEYS]
    + [StructField("bucket", TimestampType()), StructField("value_sum", DOUBLE), StructField("value_cnt", LongType())]
)
SEVERITY_SCHEMA = StructType(
    [StructField("service_name", TEXT), StructField("severity", INT), StructField("bucket", TimestampType()), StructField("cnt", LONG)]
)


def _table(spark: SparkSession, path: str, schema: StructType, layout: TableLayout, key: str | None = None) -> DayTable:
    return DayTable(spark, path, schema, layout.time_column, layout.sort_columns, key)


def span_table(spark: SparkSession, path: str) -> DayTable:
    """Spans as :func:`tables.stored_form` gives them; ``lookup`` finds those of a trace."""
    stored = StructType([StructField(f.name, TEXT if f.name in ("events", "links") else f.dataType) for f in SPAN_SCHEMA.fields])
    return _table(spark, path, stored, SPANS, "trace_id")


def log_table(spark: SparkSession, path: str) -> DayTable:
    """Log records; ``lookup`` finds those of a trace."""
    return _table(spark, path, LOG_SCHEMA, LOGS, "trace_id")


def metric_table(spark: SparkSession, path: str) -> DayTable:
    return _table(spark, path, METRIC_SCHEMA, METRICS)


def rollup_views(spark: SparkSession, path: str) -> dict[str, MaintainedView]:
    """A maintained view per rollup size; buckets of every size lie within one UTC day."""
    sort = ["name", "service_name", "bucket"]
    return {
        size: MaintainedView(
            DayTable(spark, f"{path}/rollup_{size}", ROLLUP_SCHEMA, "bucket", sort),
            partial(metrics.rollup, size=size),
            partial(metrics.merge_rollup, size=size),
        )
        for size in metrics.ROLLUP_SECONDS
    }


def severity_view(spark: SparkSession, path: str) -> MaintainedView:
    """Log records per service, severity and minute."""
    table = DayTable(spark, f"{path}/severity_1m", SEVERITY_SCHEMA, "bucket", ["service_name", "bucket"])
    return MaintainedView(table, severity_counts, merge_severity_counts)


def fold_all(views: Sequence[MaintainedView], source: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps several views up to date."""

    def write(batch: DataFrame, batch_id: int) -> None:
        for view in views:
            view.fold(batch, source, batch_id)

    return write


def routed_points(points: DayTable, views: Mapping[str, MaintainedView], start, end) -> DataFrame:
    """Points that answer ``[start, end]``: raw ones, or those of the stored rollup that fits the length of the range.

    Only the days of the range are opened.  Rollup rows carry their bucket's start and average.
    """
    resolution = metrics.select_resolution((micros(end) - micros(start)) // MICROS)
    if resolution == "1m":
        return points.read(start, end).drop("_date")
    return metrics.read_rollup(views[resolution].read(start, end))
