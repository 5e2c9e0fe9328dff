"""Message streams: decoding records from a topic, encoding rows for one, sample export.

A topic is any DataFrame with a ``value`` column, so the same code runs on a broker, on files and on
batches.  Connection options belong to the caller.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from telemill.schemas import LOG_SCHEMA, METRIC_SCHEMA
from telemill.sources.daytable import Files, Ledger

# How often a stream looks for rows; ``max_rows`` of a topic bounds how many it takes at a time.
DEFAULT_TRIGGER = {"processingTime": "30 seconds"}

TOPIC_KEYS = {"spans": "trace_id", "logs": "service_name", "metrics": "name"}

# Times in messages and in JSON columns keep microseconds.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

_CORRUPT = "_corrupt"


def open_topic(spark: SparkSession, brokers: str, topic: str, max_rows: int | None = None, **options) -> DataFrame:
    """A broker topic from its latest offset, with the message text in ``value``.

    Needs the broker connector on the class path.  ``max_rows`` bounds a micro-batch.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .options(**options)
    )
    if max_rows:
        reader = reader.option("maxOffsetsPerTrigger", max_rows)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"))


def open_text_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder of text files as a stream, one message per line."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def _decode(messages: DataFrame, schema: T.StructType) -> DataFrame:
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(
        F.col("value"), with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )
    return messages.select("value", parsed.alias("r"))


def decode(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON messages to rows; messages that do not parse are skipped."""
    good = _decode(messages, schema).filter(F.col("r").isNotNull() & F.col(f"r.{_CORRUPT}").isNull())
    return good.select("r.*").drop(_CORRUPT)


def undecodable(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """The messages :func:`decode` skips, for a reject table or a count."""
    return _decode(messages, schema).filter(F.col("r").isNull() | F.col(f"r.{_CORRUPT}").isNotNull()).select("value")


def decode_logs(messages: DataFrame) -> DataFrame:
    logs = decode(messages, LOG_SCHEMA)
    # A year-1 time is how a missing time is written by producers without null.
    observed = F.when(F.year("observed_timestamp") > 1, F.col("observed_timestamp"))
    return logs.withColumn("observed_timestamp", observed).withColumn("body", F.coalesce("body", F.lit("")))


def decode_metrics(messages: DataFrame) -> DataFrame:
    return decode(messages, METRIC_SCHEMA)


def encode(rows: DataFrame, key: str) -> DataFrame:
    """Rows as keyed JSON messages; equal keys keep their order within a topic partition."""
    return rows.select(F.col(key).alias("key"), F.to_json(F.struct("*"), JSON_OPTIONS).alias("value"))


def topic_writer(brokers: str, topic: str, key: str, **options) -> Callable[[DataFrame, int], None]:
    """Writer of micro-batches to a broker topic, keyed by ``key``.  Needs the broker connector on the class path.

    A broker takes a batch again when it is delivered again; readers that mind tell messages apart by their ids.
    """

    def write(batch: DataFrame, _: int) -> None:
        sink = encode(batch, key).write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic)
        sink.options(**options).save()

    return write


class FileTopic:
    """A topic in a folder: keyed messages, equal keys in the same of ``partitions``, each batch of a source once.

    A batch is a commit that the topic's ledger names; what a failed delivery left is never read.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, partitions: int = 8):
        self.spark, self.path, self.key, self.partitions = spark, path.rstrip("/"), key, partitions
        self.ledger = Ledger(Files(spark, self.path), f"{self.path}/ledger")

    def writer(self, source: str) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that adds a batch if its number is above the source's last one."""

        def write(batch: DataFrame, batch_id: int) -> None:
            if Ledger.knows(self.ledger.latest(), source, batch_id):
                return
            name = uuid.uuid4().hex
            part = F.pmod(F.xxhash64("key"), F.lit(self.partitions)).cast("int").alias("partition")
            messages = encode(batch, self.key).select("key", "value", part)
            messages.write.partitionBy("partition").parquet(f"{self.path}/messages/commit={name}")

            def change(document: dict) -> dict | None:
                if Ledger.knows(document, source, batch_id):
                    return None
                document.setdefault("commits", []).append(name)
                document["batches"][source] = batch_id
                return document

            self.ledger.change(change)

        return write

    def read(self) -> DataFrame:
        """All messages: key, value, partition."""
        schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("partition", T.IntegerType())])
        commits = self.ledger.latest().get("commits", [])
        if not commits:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("commit", T.StringType())]))
        paths = [f"{self.path}/messages/commit={name}" for name in commits]
        return reader.option("basePath", f"{self.path}/messages").parquet(*paths).drop("commit")


def sample_export(points: DataFrame) -> DataFrame:
    """Points in the shape of a sample write request: label list with ``__name__`` first, and the sample.

    One entry per point, as the receiving side allows several entries for one series; so no series has
    to be gathered.  Times are epoch milliseconds.
    """
    pair = "array<struct<name: string, value: string>>"
    own = F.transform(
        F.coalesce(F.sort_array(F.map_entries("labels")), F.array().cast("array<struct<key: string, value: string>>")),
        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")),
    )
    name = F.array(F.struct(F.lit("__name__").alias("name"), F.col("name").alias("value"))).cast(pair)
    return points.select(
        F.concat(name, own.cast(pair)).alias("labels"),
        F.array(F.struct("value", F.unix_millis("timestamp").alias("timestamp"))).alias("samples"),
    )
