"""Registered queries over spans: name -> (Spark plan, reference SQL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telemill.operators import analysis, service_map, spans as ops
from telemill.plans import views
from telemill.plans.views import END, SPANS_SQL, START

MIDDLE = "2024-01-16"
BASELINE, CURRENT = (START, "2024-01-15 23:59:59.999999"), (MIDDLE, END)


def _sql(body: str, service: str | None = None) -> str:
    base = f"WITH spans_v AS ({SPANS_SQL})"
    if service:
        base = f"WITH base_v AS ({SPANS_SQL}), spans_v AS (SELECT * REPLACE ({service} AS service_name) FROM base_v)"
    return f"{base}\n{body}"


def _us(column: str) -> Column:
    return F.unix_micros(column).alias(f"{column}_us")


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _by_user(spark, sf_dir) -> DataFrame:
    """Spans of many small services: one per event type and user."""
    return views.spans(spark, sf_dir).withColumn(
        "service_name", F.concat("service_name", F.lit("-"), F.col("attributes")["user"])
    )


BY_USER_SQL = "service_name || '-' || attr_user"


def service_nodes(spark, sf_dir):
    return _rounded(service_map.service_nodes(views.spans(spark, sf_dir), START, END))


SERVICE_NODES = _sql(f"""
SELECT service_name AS name, round(count(*) / 2592000.0, 6) AS call_rate,
       round(count(*) FILTER (status = 2) / count(*), 6) AS error_rate,
       round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.99), 6) AS p99_latency_ms, count(*) AS span_count
FROM spans_v WHERE start_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY 1""")


def service_edges(spark, sf_dir):
    return _rounded(service_map.service_edges(views.spans(spark, sf_dir), START, END))


_EDGES = f"""
, calls AS (
  SELECT p.service_name AS source, c.service_name AS target, CAST(c.duration_ms AS DOUBLE) AS d, c.status
  FROM spans_v c JOIN spans_v p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id
  WHERE c.parent_span_id <> '' AND p.service_name <> c.service_name
    AND c.start_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
    AND p.start_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}')
SELECT source, target, round(count(*) / 2592000.0, 6) AS call_rate,
       round(count(*) FILTER (status = 2) / count(*), 6) AS error_rate,
       round(quantile_cont(d, 0.5), 6) AS p50_latency_ms, round(quantile_cont(d, 0.95), 6) AS p95_latency_ms,
       round(quantile_cont(d, 0.99), 6) AS p99_latency_ms, count(*) AS total_calls,
       count(*) FILTER (status = 2) AS error_calls
FROM calls GROUP BY 1, 2"""


def service_edges_by_user(spark, sf_dir):
    return _rounded(service_map.service_edges(_by_user(spark, sf_dir), START, END))


def _span_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "trace_id", "span_id", "parent_span_id", "service_name", "operation_name",
        _us("start_time"), _us("end_time"), "duration_ms", F.col("status").cast("bigint").alias("status"),
        "status_message",
    )


_SPAN_COLUMNS_SQL = """trace_id, span_id, parent_span_id, service_name, operation_name,
  epoch_us(start_time) AS start_time_us, epoch_us(end_time) AS end_time_us, duration_ms,
  CAST(status AS BIGINT) AS status, status_message"""


def query_spans(spark, sf_dir):
    found = ops.query_spans(
        views.spans(spark, sf_dir), START, END, service="purchase", min_duration_ms=50, max_duration_ms=2000, status=2
    )
    return _span_columns(found)


QUERY_SPANS = _sql(f"""
SELECT {_SPAN_COLUMNS_SQL} FROM spans_v
WHERE start_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AND service_name = 'purchase'
  AND duration_ms >= 50 AND duration_ms <= 2000 AND status = 2
ORDER BY start_time DESC LIMIT 100""")


def trace_spans(spark, sf_dir):
    """All spans of the trace with the longest span."""
    all_spans = views.spans(spark, sf_dir)
    slowest = all_spans.orderBy(F.desc("duration_ms"), "trace_id").select("trace_id").first()
    return _span_columns(ops.get_spans(all_spans, slowest["trace_id"]))


TRACE_SPANS = _sql(f"""
SELECT {_SPAN_COLUMNS_SQL} FROM spans_v
WHERE trace_id = (SELECT trace_id FROM spans_v ORDER BY duration_ms DESC, trace_id LIMIT 1)""")


def assemble_trace(spark, sf_dir):
    return ops.assemble_traces(views.spans(spark, sf_dir)).select(
        "trace_id", "span_count", "has_error", F.col("root.span_id").alias("root_span_id"),
        F.col("root.operation_name").alias("root_operation"), _us("start_time"), _us("end_time"), "duration_ms",
        F.array_join("services", ",").alias("services"),
    )


ASSEMBLE_TRACE = _sql("""
SELECT trace_id, count(*) AS span_count, bool_or(status = 2) AS has_error,
       max(CASE WHEN parent_span_id = '' THEN span_id END) AS root_span_id,
       max(CASE WHEN parent_span_id = '' THEN operation_name END) AS root_operation,
       epoch_us(min(start_time)) AS start_time_us, epoch_us(max(end_time)) AS end_time_us,
       (epoch_us(max(end_time)) - epoch_us(min(start_time))) // 1000 AS duration_ms,
       string_agg(DISTINCT service_name, ',' ORDER BY service_name) AS services
FROM spans_v GROUP BY trace_id""")


def trace_timeline(spark, sf_dir):
    return _span_columns(ops.trace_timeline(views.spans(spark, sf_dir)))


TRACE_TIMELINE = _sql(f"SELECT {_SPAN_COLUMNS_SQL} FROM spans_v ORDER BY trace_id, start_time, span_id")


def summary_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "trace_id", "root_service", "root_operation", _us("trace_start"), "duration_ms", "span_count",
        "error_count", "service_count", "has_error",
    )


_SUMMARY_SQL = """
SELECT trace_id, arg_min(service_name, start_time) AS root_service, arg_min(operation_name, start_time) AS root_operation,
       epoch_us(min(start_time)) AS trace_start_us, (epoch_us(max(end_time)) - epoch_us(min(start_time))) // 1000 AS duration_ms,
       count(*) AS span_count, count(*) FILTER (status = 2) AS error_count,
       count(DISTINCT service_name) AS service_count, bool_or(status = 2) AS has_error
FROM spans_v"""


def trace_summaries(spark, sf_dir):
    return summary_columns(ops.trace_summaries(views.spans(spark, sf_dir), START, END))


TRACE_SUMMARIES = _sql(f"{_SUMMARY_SQL} GROUP BY trace_id ORDER BY trace_start_us DESC LIMIT 100")


def search_traces(spark, sf_dir):
    return summary_columns(
        ops.search_traces(
            views.spans(spark, sf_dir), START, END, service="purchase", status=2, tags={"props": '{"k": 42}'}
        )
    )


SEARCH_TRACES = _sql(f"""{_SUMMARY_SQL}
WHERE trace_id IN (SELECT trace_id FROM spans_v WHERE service_name = 'purchase' AND status = 2 AND attr_props = '{{"k": 42}}')
GROUP BY trace_id ORDER BY trace_start_us DESC LIMIT 100""")


def wide_range_search(spark, sf_dir):
    return summary_columns(
        ops.search_traces(views.spans(spark, sf_dir), START, END, operation="op-3", min_duration_ms=300, limit=250)
    )


WIDE_RANGE_SEARCH = _sql(f"""{_SUMMARY_SQL}
WHERE trace_id IN (SELECT trace_id FROM spans_v WHERE operation_name = 'op-3' AND duration_ms >= 300)
GROUP BY trace_id ORDER BY trace_start_us DESC LIMIT 250""")


def incremental_summaries(spark, sf_dir):
    """Daily states merged into summaries of all traces."""
    daily = ops.daily_trace_states(views.spans(spark, sf_dir))
    return summary_columns(ops.summaries_from_states(ops.merge_trace_states(daily)))


INCREMENTAL_SUMMARIES = _sql(f"{_SUMMARY_SQL} GROUP BY trace_id")


def slow_spans(spark, sf_dir):
    return analysis.slow_spans(views.spans(spark, sf_dir))


SLOW_SPANS = _sql("SELECT trace_id, span_id, service_name, operation_name, duration_ms FROM spans_v WHERE duration_ms >= 1000")


def error_patterns(spark, sf_dir):
    return analysis.error_patterns(views.spans(spark, sf_dir))


ERROR_PATTERNS = _sql("""
SELECT service_name, operation_name, count(*) AS "count", arg_max(status_message, start_time) AS sample
FROM spans_v WHERE status = 2 GROUP BY 1, 2""")


def p99_by_operation(spark, sf_dir):
    return _rounded(analysis.p99_by_operation(views.spans(spark, sf_dir)))


P99_BY_OPERATION = _sql("""
SELECT service_name, operation_name, round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.99), 6) AS p99_ms
FROM spans_v GROUP BY 1, 2""")


def latency_anomalies(spark, sf_dir):
    return _rounded(analysis.latency_anomalies(views.spans(spark, sf_dir), BASELINE, CURRENT, 5.0))


LATENCY_ANOMALIES = _sql(f"""
, a AS (SELECT service_name, operation_name, quantile_cont(CAST(duration_ms AS DOUBLE), 0.99) AS p FROM spans_v
        WHERE start_time BETWEEN TIMESTAMP '{BASELINE[0]}' AND TIMESTAMP '{BASELINE[1]}' GROUP BY 1, 2),
  b AS (SELECT service_name, operation_name, quantile_cont(CAST(duration_ms AS DOUBLE), 0.99) AS p FROM spans_v
        WHERE start_time BETWEEN TIMESTAMP '{CURRENT[0]}' AND TIMESTAMP '{CURRENT[1]}' GROUP BY 1, 2)
SELECT service_name, operation_name, round(a.p, 6) AS baseline_p99_ms, round(b.p, 6) AS current_p99_ms,
       round((b.p - a.p) / a.p * 100, 6) AS deviation_pct
FROM a JOIN b USING (service_name, operation_name) WHERE a.p <> 0 AND (b.p - a.p) / a.p * 100 > 5""")


def dependency_changes(spark, sf_dir):
    return analysis.dependency_changes(_by_user(spark, sf_dir), BASELINE, CURRENT)


DEPENDENCY_CHANGES = _sql(f"""
, pairs AS (
  SELECT p.service_name AS source, c.service_name AS target, c.start_time AS t, p.start_time AS pt
  FROM spans_v c JOIN spans_v p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id
  WHERE p.service_name <> c.service_name),
 a AS (SELECT DISTINCT source, target FROM pairs WHERE t BETWEEN TIMESTAMP '{BASELINE[0]}' AND TIMESTAMP '{BASELINE[1]}'
        AND pt BETWEEN TIMESTAMP '{BASELINE[0]}' AND TIMESTAMP '{BASELINE[1]}'),
 b AS (SELECT DISTINCT source, target FROM pairs WHERE t BETWEEN TIMESTAMP '{CURRENT[0]}' AND TIMESTAMP '{CURRENT[1]}'
        AND pt BETWEEN TIMESTAMP '{CURRENT[0]}' AND TIMESTAMP '{CURRENT[1]}')
SELECT source, target, 'added' AS change_type FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT source, target, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""", BY_USER_SQL)


def analysis_report(spark, sf_dir):
    """The parts of the report, with the number of findings and the worst figure of each."""
    report = analysis.analysis_report(_by_user(spark, sf_dir), *CURRENT, BASELINE, 25.0)
    worst = {
        "slow_spans": F.max("duration_ms"),
        "error_patterns": F.max("count"),
        "latency_anomalies": F.max("deviation_pct"),
        "service_changes": F.count_if(F.col("change_type") == "added"),
    }
    parts = [
        df.agg(F.count(F.lit(1)).alias("findings"), F.round(worst[part].cast("double"), 4).alias("worst")).select(
            F.lit(part).alias("part"), "findings", "worst"
        )
        for part, df in report.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


ANALYSIS_REPORT = _sql(f"""
, cur AS (SELECT * FROM spans_v WHERE start_time BETWEEN TIMESTAMP '{CURRENT[0]}' AND TIMESTAMP '{CURRENT[1]}'),
  bas AS (SELECT * FROM spans_v WHERE start_time BETWEEN TIMESTAMP '{BASELINE[0]}' AND TIMESTAMP '{BASELINE[1]}'),
  err AS (SELECT service_name, operation_name, count(*) AS n FROM cur WHERE status = 2 GROUP BY 1, 2),
  a AS (SELECT service_name, operation_name, quantile_cont(CAST(duration_ms AS DOUBLE), 0.99) AS p FROM bas GROUP BY 1, 2),
  b AS (SELECT service_name, operation_name, quantile_cont(CAST(duration_ms AS DOUBLE), 0.99) AS p FROM cur GROUP BY 1, 2),
  dev AS (SELECT (b.p - a.p) / a.p * 100 AS d FROM a JOIN b USING (service_name, operation_name) WHERE a.p <> 0),
  ec AS (SELECT DISTINCT p.service_name AS s, c.service_name AS t FROM cur c JOIN cur p
         ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE p.service_name <> c.service_name),
  eb AS (SELECT DISTINCT p.service_name AS s, c.service_name AS t FROM bas c JOIN bas p
         ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE p.service_name <> c.service_name),
  chg AS (SELECT 1.0 AS added FROM (SELECT * FROM ec EXCEPT SELECT * FROM eb)
          UNION ALL SELECT 0.0 FROM (SELECT * FROM eb EXCEPT SELECT * FROM ec))
SELECT 'slow_spans' AS part, count(*) AS findings, round(CAST(max(duration_ms) AS DOUBLE), 4) AS worst FROM cur WHERE duration_ms >= 1000
UNION ALL SELECT 'error_patterns', count(*), CAST(max(n) AS DOUBLE) FROM err
UNION ALL SELECT 'latency_anomalies', count(*), round(max(d), 4) FROM dev WHERE d > 25
UNION ALL SELECT 'service_changes', count(*), CAST(sum(added) AS DOUBLE) FROM chg""", BY_USER_SQL)


QUERIES = {
    "service_nodes": (service_nodes, SERVICE_NODES),
    "service_edges": (service_edges, _sql(_EDGES)),
    "service_edges_by_user": (service_edges_by_user, _sql(_EDGES, BY_USER_SQL)),
    "query_spans": (query_spans, QUERY_SPANS),
    "trace_spans": (trace_spans, TRACE_SPANS),
    "assemble_trace": (assemble_trace, ASSEMBLE_TRACE),
    "trace_timeline": (trace_timeline, TRACE_TIMELINE),
    "trace_summaries": (trace_summaries, TRACE_SUMMARIES),
    "search_traces": (search_traces, SEARCH_TRACES),
    "wide_range_search": (wide_range_search, WIDE_RANGE_SEARCH),
    "incremental_summaries": (incremental_summaries, INCREMENTAL_SUMMARIES),
    "slow_spans": (slow_spans, SLOW_SPANS),
    "error_patterns": (error_patterns, ERROR_PATTERNS),
    "p99_by_operation": (p99_by_operation, P99_BY_OPERATION),
    "latency_anomalies": (latency_anomalies, LATENCY_ANOMALIES),
    "dependency_changes": (dependency_changes, DEPENDENCY_CHANGES),
    "analysis_report": (analysis_report, ANALYSIS_REPORT),
}
