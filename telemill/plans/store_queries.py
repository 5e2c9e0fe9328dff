"""Registered queries over stored tables: written batch by batch with replays and late rows, kept up, read back.

Every batch of a table is a share of the given rows; the first days come last, as late data, and one batch is delivered
twice.  Tables lie in the folder the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from telemill.operators import logs as log_ops, spans as span_ops
from telemill.operators.metrics import Selector, select_points
from telemill.plans import ingest, views
from telemill.plans.metric_queries import _KEY_SQL, _points, _rollup_columns, _rollup_sql, _sql
from telemill.plans.views import END, LOGS_SQL, SPANS_SQL, START
from telemill.schemas import LOG_SCHEMA, METRIC_SCHEMA, SPAN_SCHEMA
from telemill.session import shared_dir
from telemill.sources import rollups, tables, topics
from telemill.sources.daytable import DayTable

BATCHES = 3
#: Rows of the days before this one arrive in the last batch.
LATE_BEFORE = "2024-01-04"


def batches(rows: DataFrame, time_column: str) -> list[tuple[int, DataFrame]]:
    """The rows in shares with their numbers, in the order of delivery; one share comes twice."""
    late = F.col(time_column) < F.lit(LATE_BEFORE).cast("timestamp")
    share = F.when(late, BATCHES - 1).otherwise(F.pmod(F.xxhash64(time_column), F.lit(BATCHES - 1)))
    return [(i, rows.filter(share == i)) for i in (0, 1, 1, *range(2, BATCHES))]


def _event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.event_metrics_of(views.table(spark, sf_dir, "events"))


def _filled(table: DayTable, rows: DataFrame) -> DayTable:
    """The table after all batches, compacted half-way."""
    for i, batch in batches(rows, table.time_column):
        table.append(batch, "events", i)
        if i == 1:
            table.compact()
    return table


def _rollups(spark, sf_dir, base: str):
    kept = rollups.rollup_views(spark, base)
    fold = rollups.fold_all(list(kept.values()), "events")
    for i, batch in batches(_event_metrics(spark, sf_dir), "timestamp"):
        fold(batch, i)
        if i == 1:
            for view in kept.values():
                view.compact()
    return kept


def stored_rollups(spark, sf_dir):
    """The stored rollups of all sizes."""
    kept = _rollups(spark, sf_dir, shared_dir(spark, "rollups"))
    frames = [_rollup_columns(view.read()).withColumn("rollup", F.lit(size)) for size, view in kept.items()]
    return reduce(DataFrame.unionByName, frames)


STORED_ROLLUPS = _sql(f"""
SELECT name, CAST(type AS BIGINT) AS type, {_KEY_SQL} AS series_key, service_name, (epoch_us("timestamp") // us) * us AS bucket_us,
  round(sum(value), 2) AS value_sum, count(value) AS value_cnt, rollup
FROM metrics_v, (VALUES ('5m', 300000000), ('1h', 3600000000), ('1d', 86400000000)) t(rollup, us)
WHERE name <> 'item_price' GROUP BY 1, 2, 3, 4, 5, rollup""")

ROUTES = {
    "1m": ("2024-01-10 06:00:00", "2024-01-10 07:00:00"),
    "5m": ("2024-01-10 06:00:00", "2024-01-10 11:00:00"),
    "1h": ("2024-01-02 06:00:00", "2024-01-02 18:00:00"),
    "1d": (START, END),
}


def stored_routes(spark, sf_dir):
    """A metric over four ranges, each answered from the stored table its length asks for."""
    base = shared_dir(spark, "routes")
    kept = _rollups(spark, sf_dir, base)
    points = _filled(rollups.metric_table(spark, f"{base}/points"), _event_metrics(spark, sf_dir))
    frames = []
    for route, (start, end) in ROUTES.items():
        found = select_points(rollups.routed_points(points, kept, start, end), Selector("app_value"), start, end)
        frames.append(_points(found).withColumn("value", F.round("value", 6)).withColumn("route", F.lit(route)))
    return reduce(DataFrame.unionByName, frames)


def _route_sql(route: str, us: int) -> str:
    start, end = ROUTES[route]
    return f"""SELECT name, l_type, l_shard, service_name, (epoch_us("timestamp") // {us}) * {us} AS at_us,
      round(avg(value), 6) AS value, '{route}' AS route FROM metrics_v
    WHERE name = 'app_value' GROUP BY name, l_type, l_shard, service_name, at_us
    HAVING at_us BETWEEN epoch_us(TIMESTAMP '{start}') AND epoch_us(TIMESTAMP '{end}')"""


STORED_ROUTES = _sql(
    f"""SELECT name, l_type, l_shard, service_name, epoch_us("timestamp") AS at_us, round(value, 6) AS value, '1m' AS route
    FROM metrics_v WHERE name = 'app_value' AND "timestamp" BETWEEN TIMESTAMP '{ROUTES["1m"][0]}' AND TIMESTAMP '{ROUTES["1m"][1]}'
    UNION ALL {_route_sql("5m", 300_000_000)} UNION ALL {_route_sql("1h", 3_600_000_000)} UNION ALL {_route_sql("1d", 86_400_000_000)}"""
)


def stored_severity(spark, sf_dir):
    """Maintained minute counts of the log table."""
    view = rollups.severity_view(spark, shared_dir(spark, "severity"))
    for i, batch in batches(views.logs(spark, sf_dir), "timestamp"):
        view.fold(batch, "events", i)
    view.compact()
    return view.read().select(
        "service_name", F.col("severity").cast("bigint").alias("severity"), F.unix_micros("bucket").alias("bucket_us"), "cnt"
    )


STORED_SEVERITY = f"""WITH logs_v AS ({LOGS_SQL})
SELECT service_name, CAST(severity AS BIGINT) AS severity, epoch_us(date_trunc('minute', "timestamp")) AS bucket_us, count(*) AS cnt
FROM logs_v GROUP BY 1, 2, 3"""


def _aligned(rows: DataFrame, schema) -> DataFrame:
    """The columns of a table, null where the rows have none."""
    return rows.select([F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def _stored_logs(spark, sf_dir) -> DayTable:
    return _filled(rollups.log_table(spark, shared_dir(spark, "logs")), _aligned(views.logs(spark, sf_dir), LOG_SCHEMA))


def _log_columns(logs: DataFrame) -> DataFrame:
    return logs.select(
        "span_id", "trace_id", "service_name", F.col("severity").cast("bigint").alias("severity"), "body",
        F.unix_micros("timestamp").alias("at_us"), F.col("_date").cast("string").alias("day"),
    )


_LOG_SQL = """span_id, trace_id, service_name, CAST(severity AS BIGINT) AS severity, body, epoch_us("timestamp") AS at_us,
  strftime("timestamp", '%Y-%m-%d') AS day"""


def stored_logs(spark, sf_dir):
    """The whole log table, read back."""
    return _log_columns(_stored_logs(spark, sf_dir).read())


def expired_logs(spark, sf_dir):
    """The log table after expiry by day and removal of files, what retention keeps of it."""
    table = _stored_logs(spark, sf_dir)
    table.expire(END, 7)
    table.compact()
    table.vacuum(1)
    return _log_columns(tables.apply_retention(table.read(), tables.LOGS, END, 7))


def stored_metrics(spark, sf_dir):
    """The whole metric table of events, read back."""
    table = _filled(rollups.metric_table(spark, shared_dir(spark, "points")), _event_metrics(spark, sf_dir))
    return _points(table.read()).withColumn("day", F.to_date(F.timestamp_micros("at_us")).cast("string"))


STORED_METRICS = _sql("""SELECT name, l_type, l_shard, service_name, epoch_us("timestamp") AS at_us, value,
  strftime("timestamp", '%Y-%m-%d') AS day FROM metrics_v WHERE name <> 'item_price'""")


def stored_days(spark, sf_dir):
    """Commits and rows per day after many small batches and compaction: one commit a day."""
    table = rollups.span_table(spark, shared_dir(spark, "days"))
    rows = tables.stored_form(_aligned(views.spans(spark, sf_dir), SPAN_SCHEMA))
    for i in range(6):
        table.append(rows.filter(F.pmod(F.xxhash64("span_id"), F.lit(6)) == i), "spans", i)
    table.compact()
    commits = {day: len(names) for day, names in table.days().items()}
    counted = table.read().groupBy(F.col("_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("spans"))
    of_day = F.create_map(*[F.lit(x) for pair in commits.items() for x in pair])
    return counted.withColumn("commits", of_day[F.col("day")].cast("bigint"))


STORED_DAYS = f"""WITH spans_v AS ({SPANS_SQL})
SELECT strftime(start_time, '%Y-%m-%d') AS day, count(*) AS spans, 1::BIGINT AS commits FROM spans_v GROUP BY 1"""


def failing(writer: Callable[[DataFrame, int], None], batch: int) -> Callable[[DataFrame, int], None]:
    """The writer, which fails the first time it gets the batch, after having written it."""
    failed = []

    def write(rows: DataFrame, batch_id: int) -> None:
        writer(rows, batch_id)
        if batch_id == batch and not failed:
            failed.append(batch_id)
            raise RuntimeError("sink lost its connection")

    return write


def sink_ledgers(spark, sf_dir):
    """Spans to a table and to a keyed topic; one sink fails once and the batch comes again to both: nothing is twice."""
    base = shared_dir(spark, "sinks")
    table = rollups.span_table(spark, f"{base}/table")
    topic = topics.FileTopic(spark, f"{base}/topic", topics.TOPIC_KEYS["spans"])
    rows = tables.stored_form(_aligned(views.spans(spark, sf_dir), SPAN_SCHEMA))
    sinks = tables.fan_out([failing(lambda b, i: table.append(b, "spans", i), 1), topic.writer("spans")], persist=False)
    for i in range(3):
        batch = rows.filter(F.pmod(F.xxhash64("span_id"), F.lit(3)) == i)
        for _ in range(2):
            try:
                sinks(batch, i)
                break
            except RuntimeError:
                continue
    in_table = table.read().select("trace_id", "span_id", F.lit("table").alias("sink"))
    messages = topics.decode(topic.read(), SPAN_SCHEMA)
    return in_table.unionByName(messages.select("trace_id", "span_id", F.lit("topic").alias("sink")))


SINK_LEDGERS = f"""WITH spans_v AS ({SPANS_SQL})
SELECT trace_id, span_id, sink FROM spans_v, (VALUES ('table'), ('topic')) s(sink)"""


def metric_topic(spark, sf_dir):
    """Points as keyed messages in a topic, decoded again."""
    topic = topics.FileTopic(spark, shared_dir(spark, "metric-topic"), topics.TOPIC_KEYS["metrics"])
    write = topic.writer("metrics")
    for i, batch in batches(_aligned(_event_metrics(spark, sf_dir), METRIC_SCHEMA), "timestamp"):
        write(batch, i)
    return _points(topics.decode_metrics(topic.read()))


METRIC_TOPIC = _sql("""SELECT name, l_type, l_shard, service_name, epoch_us("timestamp") AS at_us, value
FROM metrics_v WHERE name <> 'item_price'""")


def ingest_tables(spark, sf_dir):
    """All three signals of one load, each through its steps into its table: rows per signal, service and day."""
    base = shared_dir(spark, "ingest")
    stores = {"spans": rollups.span_table(spark, f"{base}/spans"), "logs": rollups.log_table(spark, f"{base}/logs"), "metrics": rollups.metric_table(spark, f"{base}/metrics")}
    signals = {
        "spans": tables.stored_form(_aligned(views.spans(spark, sf_dir), SPAN_SCHEMA)),
        "logs": _aligned(views.logs(spark, sf_dir), LOG_SCHEMA),
        "metrics": _aligned(_event_metrics(spark, sf_dir), METRIC_SCHEMA),
    }
    steps = {"spans": [lambda df: df.filter("duration_ms >= 50")], "logs": [log_ops.drop_low_severity]}
    writers = {name: [lambda b, i, s=store: s.append(b, "load", i)] for name, store in stores.items()}
    ingest.ingest_signals(signals, steps, writers)
    frames = [
        store.read().groupBy(F.col("service_name"), F.col("_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("signal", F.lit(name))
        for name, store in stores.items()
    ]
    return reduce(DataFrame.unionByName, frames)


INGEST_TABLES = f"""WITH spans_v AS ({SPANS_SQL}), logs_v AS ({LOGS_SQL}), metrics_v AS ({views.METRICS_SQL}),
 u AS (SELECT 'spans' AS signal, service_name, start_time AS seen FROM spans_v WHERE duration_ms >= 50
  UNION ALL SELECT 'logs', service_name, "timestamp" FROM logs_v WHERE severity > 5
  UNION ALL SELECT 'metrics', service_name, "timestamp" FROM metrics_v WHERE name <> 'item_price')
SELECT signal, service_name, strftime(seen, '%Y-%m-%d') AS day, count(*) AS n_rows FROM u GROUP BY ALL"""

_LOGS = f"WITH logs_v AS ({LOGS_SQL}) SELECT {_LOG_SQL} FROM logs_v"


def _slowest_trace(spark, sf_dir) -> str:
    """The trace with the longest span."""
    return views.spans(spark, sf_dir).orderBy(F.desc("duration_ms"), "trace_id").select("trace_id").first()["trace_id"]


def stored_trace(spark, sf_dir):
    """A trace looked up by id in the span table of all days: its header on each of its spans."""
    rows = tables.stored_form(_aligned(views.spans(spark, sf_dir), SPAN_SCHEMA))
    table = _filled(rollups.span_table(spark, shared_dir(spark, "trace")), rows)
    trace_id = _slowest_trace(spark, sf_dir)
    header, found = span_ops.get_trace(table.lookup(trace_id), trace_id)
    return found.join(header.select("trace_id", "span_count"), "trace_id").select(
        "trace_id", "span_id", "service_name", F.unix_micros("start_time").alias("start_us"), "duration_ms", "span_count"
    )


STORED_TRACE = f"""WITH spans_v AS ({SPANS_SQL})
SELECT trace_id, span_id, service_name, epoch_us(start_time) AS start_us, duration_ms, count(*) OVER () AS span_count FROM spans_v
WHERE trace_id = (SELECT trace_id FROM spans_v ORDER BY duration_ms DESC, trace_id LIMIT 1)"""


def stored_trace_logs(spark, sf_dir):
    """The log records of a trace, looked up by id in the log table of all days."""
    table, trace_id = _stored_logs(spark, sf_dir), _slowest_trace(spark, sf_dir)
    return _log_columns(log_ops.log_context(table.lookup(trace_id), trace_id))


STORED_TRACE_LOGS = f"""WITH logs_v AS ({LOGS_SQL}), spans_v AS ({SPANS_SQL}) SELECT {_LOG_SQL} FROM logs_v
WHERE trace_id = (SELECT trace_id FROM spans_v ORDER BY duration_ms DESC, trace_id LIMIT 1)"""

QUERIES = {
    "stored_trace": (stored_trace, STORED_TRACE),
    "stored_trace_logs": (stored_trace_logs, STORED_TRACE_LOGS),
    "stored_rollups": (stored_rollups, STORED_ROLLUPS),
    "stored_routes": (stored_routes, STORED_ROUTES),
    "stored_severity": (stored_severity, STORED_SEVERITY),
    "stored_logs": (stored_logs, _LOGS),
    "expired_logs": (
        expired_logs, f"""{_LOGS} WHERE date_trunc('second', "timestamp") + INTERVAL 7 DAY > TIMESTAMP '{END}'"""
    ),
    "stored_metrics": (stored_metrics, STORED_METRICS),
    "stored_days": (stored_days, STORED_DAYS),
    "sink_ledgers": (sink_ledgers, SINK_LEDGERS),
    "metric_topic": (metric_topic, METRIC_TOPIC),
    "ingest_tables": (ingest_tables, INGEST_TABLES),
}
