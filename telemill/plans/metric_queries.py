"""Registered queries over metric points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telemill.functions.fields import SERVICE_LABEL, series_key
from telemill.operators import metrics as ops
from telemill.operators.metrics import Selector
from telemill.plans import views
from telemill.plans.views import END, METRICS_SQL, START

GAUGE = Selector("app_value")
COUNTER = Selector("app_ticks_total")
STEP_S, RANGE_S = 3600, 4 * 3600


def _sql(body: str) -> str:
    return f"WITH metrics_v AS ({METRICS_SQL})\n{body}"


def _event_points(spark, sf_dir) -> DataFrame:
    return views.event_metrics_of(views.table(spark, sf_dir, "events"))


def _labels(df: DataFrame, *more) -> DataFrame:
    """Scalars of a vector: its two labels, service, time and value."""
    by_key = F.map_from_entries("series")
    return df.select(
        by_key["type"].alias("l_type"),
        by_key["shard"].alias("l_shard"),
        by_key[SERVICE_LABEL].alias("l_service"),
        F.unix_micros("timestamp").alias("at_us"),
        F.round("value", 6).alias("value"),
        *more,
    )


_POINT_SQL = """name, l_type, l_shard, service_name, epoch_us("timestamp") AS at_us, value"""


def _points(df: DataFrame) -> DataFrame:
    return df.select(
        "name", F.col("labels")["type"].alias("l_type"), F.col("labels")["shard"].alias("l_shard"), "service_name",
        F.unix_micros("timestamp").alias("at_us"), "value",
    )


def select_points(spark, sf_dir):
    selector = Selector("app_value", [("type", "=~", "cl.*|view"), ("shard", "!=", "0")], service="svc-1")
    return _points(ops.select_points(views.metrics(spark, sf_dir), selector, START, END))


def label_matchers(spark, sf_dir):
    """All four matcher operators and a label that is missing, on every metric."""
    points = views.metrics(spark, sf_dir)
    kept = points.filter(
        Selector("app_ticks_total", [("type", "!~", "c.*"), ("shard", "=", "2"), ("zone", "=", "")]).condition()
        | Selector("item_price", [("type", "=~", "A|N"), ("shard", "!=", "F"), ("zone", "!~", ".+")]).condition()
    )
    return _points(kept)


def matrix(spark, sf_dir):
    return ops.matrix_samples(views.metrics(spark, sf_dir)).select(
        F.col("metric")["__name__"].alias("name"), "series_key", "ts", "value"
    )


_KEY_SQL = """'{"shard":"' || l_shard || '","type":"' || l_type || '"}'"""


def matrix_steps(spark, sf_dir):
    """Array form on a one-hour grid, written out pair by pair; all metrics over their whole time."""
    stepped = ops.query_matrix(views.metrics(spark, sf_dir), "1990-01-01", "2030-01-01", 3600)
    return stepped.select("name", "series_key", F.explode("values").alias("v")).select(
        "name", "series_key", F.col("v.ts").alias("ts"), F.col("v.value").alias("value")
    )


MATRIX_STEPS = _sql(f"""
SELECT name, '{{"shard":"' || l_shard || '","type":"' || l_type || '","__service__":"' || service_name || '"}}' AS series_key,
  CAST(epoch(date_trunc('hour', "timestamp")) AS BIGINT) AS ts, max({{'t': epoch_us("timestamp"), 'v': value}}).v AS value
FROM metrics_v GROUP BY 1, 2, 3""")


def _rollup_columns(states: DataFrame) -> DataFrame:
    """The states themselves: sums of two-decimal values and counts, whose quotient read_rollup gives."""
    return states.select(
        "name", F.col("type").cast("bigint").alias("type"), series_key().alias("series_key"), "service_name",
        F.unix_micros("bucket").alias("bucket_us"), F.round("value_sum", 2).alias("value_sum"), "value_cnt",
    )


def _rollup_sql(seconds: int) -> str:
    return _sql(f"""
SELECT name, CAST(type AS BIGINT) AS type, {_KEY_SQL} AS series_key, service_name,
  (epoch_us("timestamp") // {seconds * 1_000_000}) * {seconds * 1_000_000} AS bucket_us,
  round(sum(value), 2) AS value_sum, count(value) AS value_cnt
FROM metrics_v GROUP BY 1, 2, 3, 4, 5""")


def rollup_5m(spark, sf_dir):
    return _rollup_columns(ops.rollup(views.metrics(spark, sf_dir), "5m"))


def rollup_1h(spark, sf_dir):
    return _rollup_columns(ops.rollup(views.metrics(spark, sf_dir), "1h"))


def rollup_1d(spark, sf_dir):
    return _rollup_columns(ops.rollup(views.metrics(spark, sf_dir), "1d"))


def rollup_merged(spark, sf_dir):
    """Days from hours from five-minute buckets."""
    fine = ops.rollup(views.metrics(spark, sf_dir), "5m")
    return _rollup_columns(ops.merge_rollup(ops.merge_rollup(fine, "1h"), "1d"))


def routed_points(spark, sf_dir):
    """A thirty-day range: answered from the day rollup."""
    points = views.metrics(spark, sf_dir)
    frame = ops.routed_points({"1m": points, **{size: ops.rollup(points, size) for size in ops.ROLLUP_SECONDS}}, START, END)
    found = ops.select_points(frame, GAUGE, START, END)
    return _points(found).withColumn("value", F.round("value", 6))


ROUTED_POINTS = _sql(f"""
, daily AS (SELECT name, l_type, l_shard, service_name, epoch_us(date_trunc('day', "timestamp")) AS at_us, round(avg(value), 6) AS value
  FROM metrics_v WHERE name = 'app_value' GROUP BY ALL)
SELECT name, l_type, l_shard, service_name, at_us, value FROM daily
WHERE at_us BETWEEN epoch_us(TIMESTAMP '{START}') AND epoch_us(TIMESTAMP '{END}')""")


def multi_window_agg(spark, sf_dir):
    windows = ops.multi_window_aggregate(views.metrics(spark, sf_dir))
    return window_columns(windows)


def window_columns(windows: DataFrame) -> DataFrame:
    return windows.select(
        "name", "service_name", series_key().alias("series_key"), "window_size",
        F.unix_micros("bucket").alias("bucket_us"), F.round("sum", 4).alias("sum"), "count", "min", "max",
        F.round("avg", 6).alias("avg"),
    )


def window_sql(source: str = "metrics_v", where: str = "TRUE") -> str:
    return _sql(f"""
, w AS (SELECT * FROM (VALUES ('1m', 60000000), ('5m', 300000000), ('1h', 3600000000), ('1d', 86400000000)) t(window_size, us))
SELECT name, service_name, {_KEY_SQL} AS series_key, window_size, (epoch_us("timestamp") // us) * us AS bucket_us,
  round(sum(value), 4) AS "sum", count(*) AS "count", min(value) AS "min", max(value) AS "max", round(avg(value), 6) AS "avg"
FROM {source}, w WHERE {where} GROUP BY 1, 2, 3, 4, 5""")


def list_series(spark, sf_dir):
    return ops.list_series(views.metrics(spark, sf_dir), "app_").select("name", "series_key")


def list_labels(spark, sf_dir):
    return ops.list_labels(views.metrics(spark, sf_dir), "item_price")


def label_values(spark, sf_dir):
    return ops.list_label_values(views.metrics(spark, sf_dir), "item_price", "type")


def metric_names(spark, sf_dir):
    return ops.search_metric_names(views.metrics(spark, sf_dir), "app_")


def _rates(spark, sf_dir) -> DataFrame:
    counters = _event_points(spark, sf_dir).filter(COUNTER.condition())
    return ops.rate(counters, RANGE_S, STEP_S, START, END)


def rate(spark, sf_dir):
    return _labels(_rates(spark, sf_dir))


_RATES = f"""
, ticks AS (SELECT unnest(range(epoch_us(TIMESTAMP '{START}') // 3600000000, epoch_us(TIMESTAMP '{END}') // 3600000000 + 1)) * 3600000000 AS tick),
  seen AS (
    SELECT l_type, l_shard, service_name AS l_service, tick, epoch_us(m."timestamp") AS t_us, value,
      lag(value) OVER (PARTITION BY l_type, l_shard, service_name, tick ORDER BY m."timestamp", value) AS prev
    FROM metrics_v m JOIN ticks ON epoch_us(m."timestamp") BETWEEN tick - {RANGE_S * 1_000_000} AND tick
    WHERE name = 'app_ticks_total'),
  rates AS (
    SELECT l_type, l_shard, l_service, tick AS at_us,
      sum(CASE WHEN prev IS NULL THEN 0 WHEN value >= prev THEN value - prev ELSE value END) / ((max(t_us) - min(t_us)) / 1e6) AS value
    FROM seen GROUP BY 1, 2, 3, 4 HAVING count(*) > 1 AND max(t_us) > min(t_us))"""


def sum_rate(spark, sf_dir):
    """Rates summed over shards and services, keeping the type."""
    summed = ops.aggregate_series(_rates(spark, sf_dir), "sum", ["type"])
    return _labels(summed).drop("l_shard", "l_service")


def sum_by(spark, sf_dir):
    vector = ops.instant_vector(_event_points(spark, sf_dir).filter(GAUGE.condition()), STEP_S)
    return _labels(ops.aggregate_series(vector, "sum", ["shard"])).drop("l_type", "l_service")


def avg_by(spark, sf_dir):
    """Average over all series of a metric, for every metric and day."""
    vector = ops.instant_vector(views.metrics(spark, sf_dir), 86400)
    return _labels(ops.aggregate_series(vector, "avg"), "name").drop("l_type", "l_shard", "l_service")


def _instant_sql(seconds: int) -> str:
    us = seconds * 1_000_000
    return f"""
, latest AS (
  SELECT name, l_type, l_shard, service_name AS l_service, (epoch_us("timestamp") // {us}) * {us} AS at_us,
    max({{'t': epoch_us("timestamp"), 'v': value}}).v AS value
  FROM metrics_v GROUP BY 1, 2, 3, 4, 5)"""


def histogram_quantile(spark, sf_dir):
    vector = views.histogram_vector_of(views.table(spark, sf_dir, "events"))
    return _labels(ops.histogram_quantile(vector, (0.5, 0.9, 0.99)), "q").drop("l_shard", "l_service")


_BOUNDS = "(25.0::DOUBLE), (50.0), (100.0), (200.0), (400.0), ('inf'::DOUBLE)"
HISTOGRAM_QUANTILE = f"""
WITH bounds AS (SELECT * FROM (VALUES {_BOUNDS}) b(le)),
 h AS (SELECT event_type, epoch_us(date_trunc('hour', ts)) AS at_us, le, count(*) FILTER (value <= le) AS c
       FROM events, bounds GROUP BY 1, 2, 3),
 qs AS (SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS q),
 r AS (SELECT *, q * max(c) OVER (PARTITION BY event_type, at_us, q) AS rank,
         lag(le, 1, 0.0::DOUBLE) OVER o AS lo, lag(c, 1, 0) OVER o AS prev, row_number() OVER o AS n
       FROM h, qs WINDOW o AS (PARTITION BY event_type, at_us, q ORDER BY le)),
 f AS (SELECT *, row_number() OVER (PARTITION BY event_type, at_us, q ORDER BY le) AS pick FROM r WHERE c >= rank)
SELECT event_type AS l_type, at_us, q,
  round(CASE WHEN isinf(le) THEN 400.0 ELSE lo + (le - lo) * (rank - prev) / (c - prev) END, 6) AS value
FROM f WHERE pick = 1"""


def histogram_points(spark, sf_dir):
    """Histogram points (bucket counts and bounds in arrays) to buckets to the median."""
    hourly = (
        views.table(spark, sf_dir, "events")
        .groupBy("event_type", F.date_trunc("day", "ts").alias("timestamp"))
        .agg(
            F.count_if(F.col("value") <= 25).alias("a"),
            F.count_if((F.col("value") > 25) & (F.col("value") <= 100)).alias("b"),
            F.count_if(F.col("value") > 100).alias("c"),
        )
    )
    points = hourly.select(
        F.lit("value").alias("name"),
        F.create_map(F.lit("type"), F.col("event_type")).alias("labels"),
        "timestamp",
        F.array("a", "b", "c").alias("bucket_counts"),
        F.array(F.lit(25.0), F.lit(100.0)).alias("explicit_bounds"),
    )
    return _labels(ops.histogram_quantile(ops.histogram_buckets(points), 0.5)).drop("l_shard", "l_service")


HISTOGRAM_POINTS = """
WITH d AS (SELECT event_type AS l_type, epoch_us(date_trunc('day', ts)) AS at_us, count(*) FILTER (value <= 25) AS a,
             count(*) FILTER (value <= 100) AS b, count(*) AS n FROM events GROUP BY 1, 2)
SELECT l_type, at_us, round(CASE WHEN a >= n / 2 THEN 25 * (n / 2) / a
   WHEN b >= n / 2 THEN 25 + 75 * (n / 2 - a) / (b - a) ELSE 100.0 END, 6) AS value FROM d"""


def vector_ratio(spark, sf_dir):
    """Counter over gauge, series by series and hour by hour."""
    points = _event_points(spark, sf_dir)
    top = ops.instant_vector(points.filter(COUNTER.condition()), STEP_S)
    bottom = ops.instant_vector(points.filter(GAUGE.condition()), STEP_S)
    return _labels(ops.vector_ratio(top, bottom))


def dashboard_series(spark, sf_dir):
    targets = {
        "values of clicks": Selector("app_value", [("type", "=", "click")]),
        "prices": Selector("item_price", [("shard", "=", "O")]),
        "all values": Selector("app_value"),
        "broken": Selector("app_value", [("type", "~~", "x")]),
    }
    return ops.dashboard_series(views.metrics(spark, sf_dir), targets, "1990-01-01", "2030-01-01")


DASHBOARD_SERIES = _sql(f"""
, t AS (SELECT 'values of clicks' AS target, * FROM metrics_v WHERE name = 'app_value' AND l_type = 'click'
  UNION ALL SELECT 'prices', * FROM metrics_v WHERE name = 'item_price' AND l_shard = 'O'
  UNION ALL SELECT 'all values', * FROM metrics_v WHERE name = 'app_value')
SELECT target, name, {_KEY_SQL} AS series_key, value, (epoch_us("timestamp") // 1000000) * 1000 AS ts_ms FROM t""")


QUERIES = {
    "select_points": (
        select_points,
        _sql(f"""SELECT {_POINT_SQL} FROM metrics_v m WHERE name = 'app_value' AND regexp_full_match(l_type, 'cl.*|view')
                 AND l_shard <> '0' AND service_name = 'svc-1'
                 AND "timestamp" BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"""),
    ),
    "label_matchers": (
        label_matchers,
        _sql(f"""SELECT {_POINT_SQL} FROM metrics_v WHERE
                 (name = 'app_ticks_total' AND NOT regexp_full_match(l_type, 'c.*') AND l_shard = '2')
                 OR (name = 'item_price' AND l_type IN ('A', 'N') AND l_shard <> 'F')"""),
    ),
    "matrix": (
        matrix,
        _sql(f"""SELECT name, {_KEY_SQL} AS series_key, epoch_us("timestamp") // 1000000 AS ts, value FROM metrics_v"""),
    ),
    "matrix_steps": (matrix_steps, MATRIX_STEPS),
    "rollup_5m": (rollup_5m, _rollup_sql(300)),
    "rollup_1h": (rollup_1h, _rollup_sql(3600)),
    "rollup_1d": (rollup_1d, _rollup_sql(86400)),
    "rollup_merged": (rollup_merged, _rollup_sql(86400)),
    "routed_points": (routed_points, ROUTED_POINTS),
    "multi_window_agg": (multi_window_agg, window_sql()),
    "list_series": (
        list_series,
        _sql(f"SELECT DISTINCT name, {_KEY_SQL} AS series_key FROM metrics_v WHERE name LIKE 'app\\_%' ESCAPE '\\' LIMIT 1000"),
    ),
    "list_labels": (
        list_labels,
        _sql(
            "SELECT DISTINCT substr(label, 3) AS label FROM (UNPIVOT (SELECT l_type, l_shard FROM metrics_v "
            "WHERE name = 'item_price') ON COLUMNS(*) INTO NAME label VALUE v)"
        ),
    ),
    "label_values": (
        label_values,
        _sql("SELECT DISTINCT l_type AS label_value FROM metrics_v WHERE name = 'item_price' AND l_type <> '' ORDER BY 1 LIMIT 1000"),
    ),
    "metric_names": (metric_names, _sql("SELECT DISTINCT name FROM metrics_v WHERE starts_with(name, 'app_')")),
    "rate": (rate, _sql(f"{_RATES} SELECT l_type, l_shard, l_service, at_us, round(value, 6) AS value FROM rates")),
    "sum_rate": (
        sum_rate,
        _sql(f"{_RATES} SELECT l_type, at_us, round(sum(value), 6) AS value FROM rates GROUP BY 1, 2"),
    ),
    "sum_by": (
        sum_by,
        _sql(f"{_instant_sql(STEP_S)} SELECT l_shard, at_us, round(sum(value), 6) AS value FROM latest WHERE name = 'app_value' GROUP BY 1, 2"),
    ),
    "avg_by": (
        avg_by,
        _sql(f"{_instant_sql(86400)} SELECT name, at_us, round(avg(value), 6) AS value FROM latest GROUP BY 1, 2"),
    ),
    "histogram_quantile": (histogram_quantile, HISTOGRAM_QUANTILE),
    "histogram_points": (histogram_points, HISTOGRAM_POINTS),
    "vector_ratio": (
        vector_ratio,
        _sql(f"""{_instant_sql(STEP_S)}
             SELECT l_type, l_shard, l_service, at_us, round(a.value / nullif(b.value, 0), 6) AS value
             FROM latest a JOIN latest b USING (l_type, l_shard, l_service, at_us)
             WHERE a.name = 'app_ticks_total' AND b.name = 'app_value'"""),
    ),
    "dashboard_series": (dashboard_series, DASHBOARD_SERIES),
}
