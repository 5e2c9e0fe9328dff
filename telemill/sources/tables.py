"""Signal tables as Parquet, partitioned by day and sorted inside a day."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType

from telemill.functions.timegrid import MICROS, micros, ts_lit
from telemill.schemas import SPAN_EVENT, SPAN_LINK
from telemill.sources.topics import JSON_OPTIONS

DEFAULT_RETENTION_DAYS = 7


@dataclass(frozen=True)
class TableLayout:
    """Time column of a signal and the order its rows are stored in inside a day."""

    time_column: str
    sort_columns: tuple[str, ...]


SPANS = TableLayout("start_time", ("service_name", "start_time", "trace_id", "span_id"))
LOGS = TableLayout("timestamp", ("service_name", "timestamp", "severity"))
METRICS = TableLayout("timestamp", ("name", "service_name", "timestamp"))


def with_date(df: DataFrame, layout: TableLayout) -> DataFrame:
    """Add the derived day column the tables are partitioned by."""
    return df.withColumn("_date", F.to_date(layout.time_column))


def write_table(df: DataFrame, path: str, layout: TableLayout, mode: str = "append", cluster: bool = True) -> None:
    """Write rows partitioned by day, sorted in the layout's order.

    ``cluster`` range-partitions on (day, sort columns) first: a day goes to few files with narrow value
    ranges, and because the time is part of the key a day or service with most of the rows is cut into
    several ranges.  Micro-batches pass ``cluster=False`` and only sort what each task holds.
    """
    dated = with_date(df, layout)
    order = ["_date", *layout.sort_columns]
    if cluster:
        dated = dated.repartitionByRange(*order)
    dated.sortWithinPartitions(*order).write.mode(mode).partitionBy("_date").parquet(path)


def stored_form(spans: DataFrame) -> DataFrame:
    """Spans with events and links as JSON text."""
    return spans.withColumn("events", F.to_json("events", JSON_OPTIONS)).withColumn(
        "links", F.to_json("links", JSON_OPTIONS)
    )


def write_spans(spans: DataFrame, path: str, mode: str = "append", cluster: bool = True) -> None:
    write_table(stored_form(spans), path, SPANS, mode, cluster)


def write_logs(logs: DataFrame, path: str, mode: str = "append", cluster: bool = True) -> None:
    write_table(logs, path, LOGS, mode, cluster)


def write_metrics(points: DataFrame, path: str, mode: str = "append", cluster: bool = True) -> None:
    write_table(points, path, METRICS, mode, cluster)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table; it keeps ``_date``, so the operators' time filters also prune partitions."""
    return spark.read.parquet(path).drop("batch")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    stored = read_table(spark, path)
    return stored.withColumn("events", F.from_json("events", ArrayType(SPAN_EVENT))).withColumn(
        "links", F.from_json("links", ArrayType(SPAN_LINK))
    )


def apply_retention(df: DataFrame, layout: TableLayout, as_of, days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
    """Rows not older than ``days``: a row expires once its (whole) second plus the days has come."""
    oldest = micros(as_of) - timedelta(days=days) // timedelta(microseconds=1)
    # A whole second later than ``oldest`` is the second after the one ``oldest`` lies in.
    first_kept = (oldest // MICROS + 1) * MICROS
    kept = df.filter(F.col(layout.time_column) >= ts_lit(first_kept))
    if "_date" in df.columns:
        kept = kept.filter(F.col("_date") >= F.to_date(ts_lit(first_kept)))
    return kept


def rewrite_retained(spark: SparkSession, path: str, target: str, layout: TableLayout, as_of, days: int) -> None:
    """Copy what retention keeps to a new folder, clustered; whole expired days are never read."""
    kept = apply_retention(read_table(spark, path), layout, as_of, days)
    write_table(kept, target, layout, "errorifexists")


BatchWriter = Callable[[DataFrame, int], None]


def batch_writer(path: str, layout: TableLayout, prepare: Callable[[DataFrame], DataFrame] | None = None) -> BatchWriter:
    """Writer of micro-batches to a table by day.

    A batch owns its folder and replaces it when it is delivered again, so a restart or a failed
    neighbour in a fan-out leaves no rows twice.  ``rewrite_retained`` compacts the folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        write_table(rows, f"{path}/batch={batch_id}", layout, "overwrite", cluster=False)

    return write


def fan_out(writers: Sequence[BatchWriter], persist: bool = True) -> BatchWriter:
    """A ``foreachBatch`` function handing every non-empty batch, with its number, to all writers.

    A writer that fails does not keep the others from running; all errors are raised together at the
    end, and the batch comes again to all of them.  A micro-batch is persisted once for all writers; a whole
    load is not, each writer reads it again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if persist:
            batch.persist()
        try:
            if batch.isEmpty():
                return
            errors = []
            for writer in writers:
                try:
                    writer(batch, batch_id)
                except Exception as error:  # collected, raised below
                    errors.append(error)
            if errors:
                raise RuntimeError("; ".join(f"{type(e).__name__}: {e}" for e in errors)) from errors[0]
        finally:
            if persist:
                batch.unpersist()

    return write

