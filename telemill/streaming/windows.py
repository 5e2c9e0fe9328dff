"""Windowed aggregates over streams, by event time and watermark."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from telemill.functions.timegrid import bucket_start, micros
from telemill.operators.metrics import WINDOW_SECONDS
from telemill.operators.spans import trace_states

DEFAULT_DELAY = "10 minutes"


_KEYS = ["name", "service_name", "labels"]


def _emitted(windowed: DataFrame, size: str) -> DataFrame:
    return windowed.select(
        *_KEYS,
        F.lit(size).alias("window_size"),
        F.col("w.start").alias("bucket"),
        "sum",
        "count",
        "min",
        "max",
        F.try_divide("sum", "count").alias("avg"),
    )


def _stream_window(points: DataFrame, size: str, seconds: int) -> DataFrame:
    windowed = points.groupBy(F.window("timestamp", f"{seconds} seconds").alias("w"), *_KEYS).agg(
        F.sum("value").alias("sum"),
        F.count("value").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return _emitted(windowed, size)


def stream_multi_window(
    points: DataFrame, delay: str = DEFAULT_DELAY, sizes: Mapping[str, int] | None = None
) -> DataFrame:
    """sum, count, min, max, avg per series, service and tumbling window, each window emitted once.

    One watermark, one aggregate per size, their union a single append-mode query.  A window is emitted
    when the watermark passes its end, later rows for it are dropped (see :func:`late_rows`); a row late
    for its minute still counts for its hour.  Every size reads the source.  For large streams run the
    finest size alone, write it to a table and feed that to :func:`coarser_window_writer`.
    """
    source = points.withWatermark("timestamp", delay)
    frames = [_stream_window(source, size, seconds) for size, seconds in (sizes or WINDOW_SECONDS).items()]
    return reduce(DataFrame.unionByName, frames)


def _merged(states: DataFrame) -> DataFrame:
    return states.groupBy(*_KEYS, "window_size", "bucket").agg(
        F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max")
    )


def coarser_window_writer(path: str, sizes: Mapping[str, int]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for a stream of emitted finest windows: appends their coarser states to a table.

    The raw points are then read and aggregated once, whatever the number of sizes.  States are merged when read
    (:func:`read_coarser_windows`), so files may come in any order and number per batch, none is late, and windows
    that are still open are there as far as they go.  A batch owns its folder and replaces it when it is run again.
    Every size must be a multiple of the finest.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        windows = F.array(
            *[F.struct(F.lit(size).alias("size"), bucket_start(F.col("bucket"), s).alias("bucket")) for size, s in sizes.items()]
        )
        rows = batch.select(*_KEYS, F.explode(windows).alias("w"), "sum", "count", "min", "max")
        states = _merged(rows.withColumns({"window_size": F.col("w.size"), "bucket": F.col("w.bucket")}))
        states.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_coarser_windows(states: DataFrame) -> DataFrame:
    """Coarser windows from the table of their states."""
    return _merged(states).withColumn("avg", F.try_divide("sum", "count"))


def stream_severity_counts(logs: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Records per service, severity and minute; a minute is emitted once the watermark passes it."""
    return (
        logs.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 minute").alias("w"), "service_name", "severity")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select("service_name", "severity", F.col("w.start").alias("bucket"), "cnt")
    )


def trace_state_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function appending the trace states of a span stream to a table.

    Partial states are merged when read (``merge_trace_states``), so the stream itself keeps no state
    however long traces live.  A batch owns its folder: a batch that is run again replaces its rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        trace_states(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in schema.fields])


def with_closing(stream: DataFrame, folder: str) -> DataFrame:
    """``stream`` and the rows that :func:`close_stream` puts into ``folder``."""
    spark, schema = stream.sparkSession, _nullable(stream.schema)
    spark.createDataFrame([], schema).write.mode("ignore").parquet(folder)
    return stream.unionByName(spark.readStream.schema(schema).parquet(folder))


def close_stream(spark: SparkSession, schema: StructType, folder: str, time_column: str, **values) -> None:
    """End the input of a stream of :func:`with_closing`: one row so late that every window of the data closes.

    Its time is the year 2262, the last that pandas can hold, as a timestamp or in microseconds as the column's type asks for; the other columns are
    null but for ``values``.  Its own windows never close, so it shows in no result.  Run the query once more after it.
    """
    end = datetime(2262, 1, 1, tzinfo=timezone.utc)
    end = end if isinstance(schema[time_column].dataType, TimestampType) else micros(end)
    row = {time_column: end, **values}
    spark.createDataFrame([tuple(row.get(c) for c in schema.names)], _nullable(schema)).write.mode("append").parquet(folder)


def late_rows(query) -> int:
    """Rows a query has dropped because they came after the watermark."""
    return sum(
        operator.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
