"""The three signals as views over the given event and line item tables.

A trace is eight consecutive events linked as a binary tree.  The same definitions stand as SQL in
``SPANS_SQL``, ``LOGS_SQL`` and ``METRICS_SQL`` for the reference results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemill.session import prepare_session

START, END = "2024-01-01", "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_session(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "events"))


def spans_of(events: DataFrame) -> DataFrame:
    event_id = F.col("event_id")
    place = event_id % 8
    trace = F.call_function("div", event_id, F.lit(8))
    failed = event_id % 11 == 0
    duration = F.floor(F.col("value") * 10).cast("bigint")
    return events.select(
        F.concat(F.lit("t"), trace.cast("string")).alias("trace_id"),
        F.concat(F.lit("s"), event_id.cast("string")).alias("span_id"),
        F.when(place == 0, "")
        .otherwise(F.concat(F.lit("s"), (trace * 8 + F.call_function("div", place - 1, F.lit(2))).cast("string")))
        .alias("parent_span_id"),
        F.lit("").alias("trace_state"),
        F.col("event_type").alias("service_name"),
        F.concat(F.lit("op-"), (F.col("user_id") % 5).cast("string")).alias("operation_name"),
        F.col("ts").alias("start_time"),
        F.timestamp_micros(F.unix_micros("ts") + duration * 1000).alias("end_time"),
        duration.alias("duration_ms"),
        F.when(failed, 2).when(event_id % 3 == 0, 0).otherwise(1).alias("status"),
        F.when(failed, F.concat(F.lit("failed "), F.col("event_type"))).otherwise("").alias("status_message"),
        (event_id % 6).cast("int").alias("kind"),
        F.create_map(
            F.lit("user"), F.col("user_id").cast("string"), F.lit("props"), F.col("props")
        ).alias("attributes"),
        F.create_map(F.lit("service.name"), F.col("event_type")).alias("resource_attributes"),
    )


SPANS_SQL = """
SELECT 't' || (event_id // 8) AS trace_id,
       's' || event_id AS span_id,
       CASE WHEN event_id % 8 = 0 THEN '' ELSE 's' || ((event_id // 8) * 8 + (event_id % 8 - 1) // 2) END AS parent_span_id,
       event_type AS service_name,
       'op-' || (user_id % 5) AS operation_name,
       ts AS start_time,
       ts + to_milliseconds(CAST(floor(value * 10) AS BIGINT)) AS end_time,
       CAST(floor(value * 10) AS BIGINT) AS duration_ms,
       CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS status,
       CASE WHEN event_id % 11 = 0 THEN 'failed ' || event_type ELSE '' END AS status_message,
       event_id % 6 AS kind,
       CAST(user_id AS VARCHAR) AS attr_user,
       props AS attr_props
FROM events
"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of(table(spark, sf_dir, "events"))


def logs_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    event_id = F.col("event_id")
    user = F.col("user_id").cast("string")
    body = (
        F.when(kind == "error", F.concat(F.lit("TimeoutError: upstream, user_id="), user))
        .when(
            kind == "purchase",
            F.concat(F.lit("POST /buy HTTP/1.1 201 duration="), (event_id % 900).cast("string"), F.lit("ms")),
        )
        .when(kind == "signup", F.concat(F.lit("get /join HTTP/1.1 200 user id: "), user))
        .otherwise(F.concat(F.lit("nothing to see "), event_id.cast("string")))
    )
    return events.select(
        F.col("ts").alias("timestamp"),
        F.when(event_id % 5 != 0, F.col("ts")).alias("observed_timestamp"),
        F.when(kind == "error", 17).when(kind == "purchase", 13).when(kind == "signup", 9).when(kind == "view", 5)
        .otherwise(6).alias("severity"),
        kind.alias("severity_text"),
        body.alias("body"),
        F.when(event_id % 7 == 0, "").otherwise(kind).alias("service_name"),
        F.concat(F.lit("t"), F.call_function("div", event_id, F.lit(8)).cast("string")).alias("trace_id"),
        F.concat(F.lit("s"), event_id.cast("string")).alias("span_id"),
        F.lit(0).cast("bigint").alias("trace_flags"),
        F.create_map(F.lit("service.name"), F.concat(F.lit("res-"), kind)).alias("resource_attributes"),
        F.create_map(F.lit("props"), F.col("props")).alias("log_attributes"),
    )


LOGS_SQL = """
SELECT ts AS "timestamp",
       CASE WHEN event_id % 5 <> 0 THEN ts END AS observed_timestamp,
       CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9 WHEN 'view' THEN 5 ELSE 6 END AS severity,
       event_type AS severity_text,
       CASE event_type
         WHEN 'error'    THEN 'TimeoutError: upstream, user_id=' || user_id
         WHEN 'purchase' THEN 'POST /buy HTTP/1.1 201 duration=' || (event_id % 900) || 'ms'
         WHEN 'signup'   THEN 'get /join HTTP/1.1 200 user id: ' || user_id
         ELSE 'nothing to see ' || event_id END AS body,
       CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS service_name,
       't' || (event_id // 8) AS trace_id,
       's' || event_id AS span_id,
       'res-' || event_type AS resource_service
FROM events
"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_of(table(spark, sf_dir, "events"), table(spark, sf_dir, "lineitem"))


def _points(name: str, kind: int, first_label, second_label, value, at, service) -> list:
    return [
        F.lit(name).alias("name"),
        F.lit("").alias("description"),
        F.lit("").alias("unit"),
        F.lit(kind).alias("type"),
        F.create_map(F.lit("type"), first_label, F.lit("shard"), second_label).alias("labels"),
        value.cast("double").alias("value"),
        at.alias("timestamp"),
        F.concat(F.lit("svc-"), (service % 4).cast("string")).alias("service_name"),
    ]


def event_metrics_of(events: DataFrame) -> DataFrame:
    shard = (F.col("user_id") % 3).cast("string")
    gauge = _points("app_value", 1, F.col("event_type"), shard, F.col("value"), F.col("ts"), F.col("user_id"))
    counter = _points(
        "app_ticks_total", 2, F.col("event_type"), shard, F.col("event_id") % 400, F.col("ts"), F.col("user_id")
    )
    # One scan gives both metrics.
    return events.select(F.explode(F.array(F.struct(*gauge), F.struct(*counter))).alias("m")).select("m.*")


def metrics_of(events: DataFrame, lineitem: DataFrame) -> DataFrame:
    price = lineitem.select(
        *_points(
            "item_price", 1, F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_extendedprice"),
            F.col("l_shipdate"), F.col("l_suppkey"),
        )
    )
    return event_metrics_of(events).unionByName(price)


METRICS_SQL = """
SELECT 'app_value' AS name, 1 AS type, event_type AS l_type, CAST(user_id % 3 AS VARCHAR) AS l_shard,
       value, ts AS "timestamp", 'svc-' || (user_id % 4) AS service_name FROM events
UNION ALL
SELECT 'app_ticks_total', 2, event_type, CAST(user_id % 3 AS VARCHAR),
       CAST(event_id % 400 AS DOUBLE), ts, 'svc-' || (user_id % 4) FROM events
UNION ALL
SELECT 'item_price', 1, l_returnflag, l_linestatus, l_extendedprice, l_shipdate, 'svc-' || (l_suppkey % 4) FROM lineitem
"""


def histogram_vector_of(events: DataFrame) -> DataFrame:
    """Cumulative hourly counts of event values per type, as a vector with an ``le`` label."""
    bounds = ["25", "50", "100", "200", "400"]
    below = [F.count_if(F.col("value") <= float(b)).alias(f"b{b}") for b in bounds]
    hourly = events.groupBy("event_type", F.date_trunc("hour", "ts").alias("timestamp")).agg(
        *below, F.count(F.lit(1)).alias("all")
    )
    pairs = F.array(
        *[F.struct(F.lit(b).alias("le"), F.col(f"b{b}").alias("upto")) for b in bounds],
        F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("upto")),
    )
    entry = "array<struct<key: string, value: string>>"
    return hourly.withColumn("p", F.explode(pairs)).select(
        F.lit("value_bucket").alias("name"),
        F.array(
            F.struct(F.lit("le").alias("key"), F.col("p.le").alias("value")),
            F.struct(F.lit("type").alias("key"), F.col("event_type").alias("value")),
        ).cast(entry).alias("series"),
        "timestamp",
        F.col("p.upto").cast("double").alias("value"),
    )
