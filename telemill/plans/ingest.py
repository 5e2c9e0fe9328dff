"""Ingest: processors in order, then the sinks, for one signal or for all three."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from telemill.operators.processors import run_processors
from telemill.sources.tables import BatchWriter, fan_out
from telemill.sources.topics import DEFAULT_TRIGGER

Step = Callable[[DataFrame], DataFrame]


def ingest_batch(rows: DataFrame, steps: Sequence[Step], writers: Sequence[BatchWriter]) -> None:
    """Run the steps and hand what is left to every writer."""
    fan_out(writers, persist=False)(run_processors(rows, steps), 0)


def ingest_stream(
    rows: DataFrame,
    steps: Sequence[Step],
    writers: Sequence[BatchWriter],
    checkpoint: str,
    trigger: Mapping | None = None,
) -> DataStreamWriter:
    """A stream writer for the same; start it with ``.start()``.

    The checkpoint belongs in the cluster's shared folder (``telemill.shared_dir``).  A batch that
    failed half-way is delivered again to all writers.
    """
    return (
        run_processors(rows, steps)
        .writeStream.foreachBatch(fan_out(writers))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or DEFAULT_TRIGGER))
    )


def ingest_signals(
    signals: Mapping[str, DataFrame],
    steps: Mapping[str, Sequence[Step]],
    writers: Mapping[str, Sequence[BatchWriter]],
) -> None:
    """Spans, logs and metrics of one batch, each through its own steps and writers."""
    for signal, rows in signals.items():
        ingest_batch(rows, steps.get(signal, ()), writers[signal])
