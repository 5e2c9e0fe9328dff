"""Registered queries over logs (and whole documents as log bodies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from telemill.functions.fields import BODY_PATTERNS, contains_ignoring_ascii_case, has_error
from telemill.operators import logs as ops
from telemill.operators.spans import summaries_from_states, trace_states
from telemill.plans import views
from telemill.plans.views import END, LOGS_SQL, SPANS_SQL, START

FIELDS = [name for name, _, _ in BODY_PATTERNS]


def _sql(body: str) -> str:
    return f"WITH logs_v AS ({LOGS_SQL}), spans_v AS ({SPANS_SQL})\n{body}"


def _columns(logs: DataFrame, *more) -> DataFrame:
    return logs.select(
        F.unix_micros("timestamp").alias("at_us"), F.col("severity").cast("bigint").alias("severity"), "body",
        "service_name", "trace_id", "span_id", *more,
    )


_COLUMNS_SQL = """epoch_us("timestamp") AS at_us, CAST(severity AS BIGINT) AS severity, body, service_name, trace_id, span_id"""
_RANGE_SQL = f"""l."timestamp" BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"""


def search_logs(spark, sf_dir):
    found = ops.search_logs(
        views.logs(spark, sf_dir), START, END, service="error", min_severity=13, keyword="USER_ID=1"
    )
    return _columns(found)


def keyword_search(spark, sf_dir):
    return _columns(ops.keyword_search(views.logs(spark, sf_dir), "http/1.1 20", START, END, limit=1000))


def exact_severity_search(spark, sf_dir):
    found = ops.search_logs(
        views.logs(spark, sf_dir), START, END, service="signup", severity=9, keyword="get /join", case_sensitive=True,
        limit=1000,
    )
    return _columns(found)


def severity_at_least(spark, sf_dir):
    return _columns(ops.at_least_severity(views.logs(spark, sf_dir), 17, START, END, limit=500))


def span_log_search(spark, sf_dir):
    """Logs of one span: the slowest one."""
    slowest = views.spans(spark, sf_dir).orderBy(F.desc("duration_ms"), "span_id").select("trace_id", "span_id").first()
    found = ops.search_logs(
        views.logs(spark, sf_dir), "1990-01-01", "2030-01-01", trace_id=slowest["trace_id"], span_id=slowest["span_id"], limit=None
    )
    return _columns(found)


def trace_log_context(spark, sf_dir):
    """All logs of the trace of the slowest span."""
    slowest = views.spans(spark, sf_dir).orderBy(F.desc("duration_ms"), "span_id").select("trace_id").first()
    return _columns(ops.log_context(views.logs(spark, sf_dir), slowest["trace_id"]))


def keyword_search_documents(spark, sf_dir):
    """Keyword with letters outside ASCII over whole document texts; those letters are not folded."""
    documents = views.table(spark, sf_dir, "documents")
    return documents.filter(contains_ignoring_ascii_case("text", "éTION")).select("doc_id", "n_chars")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
KEYWORD_SEARCH_DOCUMENTS = f"""
SELECT doc_id, n_chars FROM documents WHERE contains(translate(text, {_AZ}), translate('éTION', {_AZ}))"""


def log_context(spark, sf_dir):
    """All logs of the traces that have a failed span."""
    failed = views.spans(spark, sf_dir).filter(has_error()).select("trace_id")
    return _columns(ops.log_contexts(views.logs(spark, sf_dir), failed))


def nearby_logs(spark, sf_dir):
    """Same-service logs up to five minutes around the twenty longest traces."""
    summaries = summaries_from_states(trace_states(views.spans(spark, sf_dir)))
    longest = summaries.orderBy(F.desc("duration_ms"), "trace_id").limit(20)
    return _columns(ops.nearby_logs(views.logs(spark, sf_dir), longest, 300), "context_trace_id")


NEARBY_LOGS = _sql(f"""
, longest AS (SELECT trace_id FROM spans_v GROUP BY trace_id
              ORDER BY (epoch_us(max(end_time)) - epoch_us(min(start_time))) // 1000 DESC, trace_id LIMIT 20),
  own AS (SELECT trace_id AS context_trace_id, service_name AS svc, min("timestamp") AS t0, max("timestamp") AS t1
          FROM logs_v WHERE trace_id IN (SELECT trace_id FROM longest) GROUP BY 1, 2)
SELECT {_COLUMNS_SQL}, context_trace_id FROM logs_v l JOIN own ON l.service_name = own.svc
 AND l."timestamp" BETWEEN own.t0 - INTERVAL 5 MINUTE AND own.t1 + INTERVAL 5 MINUTE""")


def severity_counts(spark, sf_dir):
    counted = ops.severity_counts(views.logs(spark, sf_dir))
    return counted.select(
        "service_name", F.col("severity").cast("bigint").alias("severity"), F.unix_micros("bucket").alias("bucket_us"), "cnt"
    )


SEVERITY_COUNTS = _sql("""
SELECT service_name, CAST(severity AS BIGINT) AS severity, epoch_us(date_trunc('minute', "timestamp")) AS bucket_us, count(*) AS cnt
FROM logs_v GROUP BY 1, 2, 3""")


def severity_counts_merged(spark, sf_dir):
    """Counts of two batches (split by hash) merged."""
    logs = views.logs(spark, sf_dir)
    part = F.pmod(F.xxhash64("span_id"), F.lit(2))
    counts = ops.severity_counts(logs.filter(part == 0)).unionByName(ops.severity_counts(logs.filter(part == 1)))
    merged = ops.merge_severity_counts(counts)
    return merged.select(
        "service_name", F.col("severity").cast("bigint").alias("severity"), F.unix_micros("bucket").alias("bucket_us"), "cnt"
    )


def drop_low_severity(spark, sf_dir):
    return _columns(ops.drop_low_severity(views.logs(spark, sf_dir)))


def log_enrich(spark, sf_dir):
    enriched = ops.enrich_logs(views.logs(spark, sf_dir), F.timestamp_micros(F.lit(1_700_000_000_000_000)))
    return _columns(enriched, F.unix_micros("observed_timestamp").alias("observed_us"))


LOG_ENRICH = _sql(f"""
SELECT * EXCLUDE (resource_service)
  REPLACE (CASE WHEN service_name = '' THEN resource_service ELSE service_name END AS service_name)
FROM (SELECT {_COLUMNS_SQL}, coalesce(epoch_us(observed_timestamp), 1700000000000000) AS observed_us, resource_service FROM logs_v)""")


def _fields(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.coalesce(F.col("structured_fields")[f], F.lit("")).alias(f) for f in FIELDS])


# The patterns in the notation of the engine that computes the reference result.
USER_ID_SQL = r"regexp_extract({0}, 'user[_\s]?id[=:\s]+(\d+)', 1) AS user_id"
_FIELDS_SQL = r"""
  regexp_extract({0}, '(?i)(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+/', 1) AS http_method,
  regexp_extract({0}, '\bHTTP[/ ][\d.]+\s+(\d{{3}})\b', 1) AS http_status,
  regexp_extract({0}, '([A-Z][a-zA-Z]+Error|[A-Z][a-zA-Z]+Exception):', 1) AS error_type,
  regexp_extract({0}, 'duration[=:\s]+([\d.]+)\s*ms', 1) AS duration_ms,
  """ + USER_ID_SQL


def extract_fields(spark, sf_dir):
    return _fields(ops.extract_fields(views.logs(spark, sf_dir)), "span_id")


def extract_fields_documents(spark, sf_dir):
    """Extraction from long bodies: the whole text of every document, a log line in front and behind."""
    documents = views.table(spark, sf_dir, "documents")
    body = F.concat(
        F.lit("Duration duration: "), F.col("n_chars").cast("string"), F.lit(" ms "), F.col("text"),
        F.lit("\nOutOfDiskException: user_id="), F.col("doc_id").cast("string"),
    )
    return _fields(ops.extract_fields(documents.withColumn("body", body)), "doc_id")


def stream_steps(spark, sf_dir):
    """Everything a record of the log stream goes through, as one batch."""
    done = ops.process_logs(views.logs(spark, sf_dir), F.timestamp_micros(F.lit(1_700_000_000_000_000)))
    return _fields(done, "span_id", "service_name")


QUERIES = {
    "search_logs": (
        search_logs,
        _sql(f"""SELECT {_COLUMNS_SQL} FROM logs_v l WHERE {_RANGE_SQL} AND service_name = 'error' AND severity >= 13
                 AND contains(lower(body), 'user_id=1') ORDER BY at_us DESC LIMIT 200"""),
    ),
    "keyword_search": (
        keyword_search,
        _sql(f"SELECT {_COLUMNS_SQL} FROM logs_v l WHERE {_RANGE_SQL} AND contains(lower(body), 'http/1.1 20') ORDER BY at_us DESC LIMIT 1000"),
    ),
    "exact_severity_search": (
        exact_severity_search,
        _sql(f"""SELECT {_COLUMNS_SQL} FROM logs_v l WHERE {_RANGE_SQL} AND service_name = 'signup' AND severity = 9
                 AND contains(body, 'get /join') ORDER BY at_us DESC LIMIT 1000"""),
    ),
    "severity_at_least": (
        severity_at_least,
        _sql(f"SELECT {_COLUMNS_SQL} FROM logs_v l WHERE {_RANGE_SQL} AND severity >= 17 ORDER BY at_us DESC LIMIT 500"),
    ),
    "span_log_search": (
        span_log_search,
        _sql(f"SELECT {_COLUMNS_SQL} FROM logs_v WHERE span_id = (SELECT span_id FROM spans_v ORDER BY duration_ms DESC, span_id LIMIT 1)"),
    ),
    "trace_log_context": (
        trace_log_context,
        _sql(f"SELECT {_COLUMNS_SQL} FROM logs_v WHERE trace_id = (SELECT trace_id FROM spans_v ORDER BY duration_ms DESC, span_id LIMIT 1)"),
    ),
    "keyword_search_documents": (keyword_search_documents, KEYWORD_SEARCH_DOCUMENTS),
    "log_context": (
        log_context,
        _sql(f"SELECT {_COLUMNS_SQL} FROM logs_v WHERE trace_id IN (SELECT trace_id FROM spans_v WHERE status = 2)"),
    ),
    "nearby_logs": (nearby_logs, NEARBY_LOGS),
    "severity_counts": (severity_counts, SEVERITY_COUNTS),
    "severity_counts_merged": (severity_counts_merged, SEVERITY_COUNTS),
    "drop_low_severity": (drop_low_severity, _sql(f"SELECT {_COLUMNS_SQL} FROM logs_v WHERE severity > 5")),
    "log_enrich": (log_enrich, LOG_ENRICH),
    "extract_fields": (extract_fields, _sql(f"SELECT span_id, {_FIELDS_SQL.format('body')} FROM logs_v")),
    "extract_fields_documents": (
        extract_fields_documents,
        "WITH d AS (SELECT doc_id, 'Duration duration: ' || n_chars || ' ms ' || text || chr(10) || "
        f"'OutOfDiskException: user_id=' || doc_id AS body FROM documents) SELECT doc_id, {_FIELDS_SQL.format('body')} FROM d",
    ),
    "stream_steps": (
        stream_steps,
        _sql(
            "SELECT span_id, CASE WHEN service_name = '' THEN resource_service ELSE service_name END AS service_name, "
            f"{_FIELDS_SQL.format('body')} FROM logs_v WHERE severity > 5"
        ),
    ),
}
