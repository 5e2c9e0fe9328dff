"""Registered queries over single rows: processors, names, ingest decoding, export shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telemill.functions import fields
from telemill.operators import processors
from telemill.operators.processors import AttributeRule
from telemill.plans import views
from telemill.plans.views import END, LOGS_SQL, METRICS_SQL, SPANS_SQL
from telemill.sources import otlp, tables, topics


def _spans_sql(body: str) -> str:
    return f"WITH spans_v AS ({SPANS_SQL})\n{body}"


def _attribute(key: str) -> Column:
    return F.col("attributes")[key].alias(f"attr_{key}")


def _changed(spark, sf_dir, *rules: AttributeRule) -> DataFrame:
    return processors.change_attributes(views.spans(spark, sf_dir), rules)


def normalize_service(spark, sf_dir):
    named = views.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_brand", F.lit("/"), "p_type", F.lit("_"), "p_name").alias("service_name")
    )
    return processors.normalize_services(named)


NORMALIZE_SERVICE = """
SELECT p_partkey, replace(replace(replace(lower(p_brand || '/' || p_type || '_' || p_name), '/', '-'), ' ', '-'), '_', '-') AS service_name
FROM part"""


def attr_add(spark, sf_dir):
    added = _changed(spark, sf_dir, AttributeRule("add", "env", value="production"), AttributeRule("add", "user", value="x"))
    return added.select("span_id", _attribute("env"), _attribute("user"), _attribute("props"))


def attr_remove(spark, sf_dir):
    return _changed(spark, sf_dir, AttributeRule("remove", "props")).select(
        "span_id", _attribute("user"), _attribute("props"), F.size("attributes").cast("bigint").alias("n")
    )


def attr_rename(spark, sf_dir):
    renamed = _changed(
        spark, sf_dir, AttributeRule("rename", "props", new_key="user"), AttributeRule("rename", "none", new_key="other")
    )
    return renamed.select(
        "span_id", _attribute("user"), _attribute("props"), _attribute("other"), F.size("attributes").cast("bigint").alias("n")
    )


def attr_hash(spark, sf_dir):
    return _changed(spark, sf_dir, AttributeRule("hash", "props")).select(
        "span_id", _attribute("user"), _attribute("props")
    )


ATTR_HASH = _spans_sql("""
, hashed AS (
  SELECT span_id, attr_user,
    list_reduce(
      list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(attr_props) + 1), lambda i: ascii(attr_props[i])::HUGEINT)),
      lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h
  FROM spans_v)
SELECT span_id, attr_user, format('{:x}', h::UBIGINT) AS attr_props FROM hashed""")


def attr_pattern(spark, sf_dir):
    rule = AttributeRule("remove", "props", pattern="[02468]}$")
    return _changed(spark, sf_dir, rule).select("span_id", _attribute("props"))


def log_attributes(spark, sf_dir):
    rules = [AttributeRule("rename", "props", new_key="payload"), AttributeRule("add", "env", value="test")]
    changed = processors.change_attributes(views.logs(spark, sf_dir), rules, "log_attributes")
    return changed.select(
        "span_id", F.col("log_attributes")["payload"].alias("payload"), F.col("log_attributes")["env"].alias("env"),
        F.col("log_attributes")["props"].alias("props"),
    )


def head_sample(spark, sf_dir):
    kept = processors.head_sample(views.spans(spark, sf_dir), 0.0, {"purchase": 1.0, "error": 0.0})
    return kept.select("span_id", "service_name", F.col("status").cast("bigint").alias("status"))


def head_sample_half(spark, sf_dir):
    """A share in between."""
    return processors.head_sample(views.spans(spark, sf_dir), 0.5).select("trace_id", "span_id")


def tail_sample(spark, sf_dir):
    return processors.tail_sample(views.spans(spark, sf_dir), 0.3).select("trace_id", "span_id")


def enum_names(spark, sf_dir):
    return views.spans(spark, sf_dir).select(
        "span_id",
        fields.status_name("status").alias("status_name"),
        fields.kind_name("kind").alias("kind_name"),
        fields.metric_type_name("kind").alias("type_name"),
        fields.is_root().alias("is_root"),
        fields.has_error().alias("has_error"),
    )


ENUM_NAMES = _spans_sql("""
SELECT span_id,
  CASE status WHEN 1 THEN 'ok' WHEN 2 THEN 'error' ELSE 'unset' END AS status_name,
  CASE kind WHEN 1 THEN 'internal' WHEN 2 THEN 'server' WHEN 3 THEN 'client' WHEN 4 THEN 'producer' WHEN 5 THEN 'consumer' ELSE 'unspecified' END AS kind_name,
  CASE kind WHEN 1 THEN 'gauge' WHEN 2 THEN 'counter' WHEN 3 THEN 'histogram' WHEN 4 THEN 'summary' ELSE 'unspecified' END AS type_name,
  parent_span_id = '' AS is_root, status = 2 AS has_error
FROM spans_v""")


def severity_names(spark, sf_dir):
    """Severity numbers 0-24 to names, names to numbers, and the predicates on logs."""
    events = views.table(spark, sf_dir, "events")
    number = (F.col("event_id") % 25).cast("int")
    level = F.element_at(
        F.array(*[F.lit(x) for x in _LEVELS]), (F.col("event_id") % len(_LEVELS) + 1).cast("int")
    )
    return events.select(
        "event_id",
        fields.severity_name(number).alias("severity_name"),
        fields.parse_severity(level).cast("bigint").alias("parsed"),
        fields.is_error_log(number).alias("is_error"),
        fields.has_trace(F.when(F.col("event_id") % 3 > 0, F.lit("t"))).alias("has_trace"),
    )


_LEVELS = ("INFO", "info", "ERROR", "WARN", "WARNING", "warning", "DEBUG", "FATAL", "trace", "Error", "unknown")

SEVERITY_NAMES = f"""
WITH l AS (SELECT event_id, event_id % 25 AS n, ([{', '.join(repr(x) for x in _LEVELS)}])[event_id % {len(_LEVELS)} + 1] AS level FROM events)
SELECT event_id,
  CASE WHEN n >= 21 THEN 'FATAL' WHEN n >= 17 THEN 'ERROR' WHEN n >= 13 THEN 'WARN' WHEN n >= 9 THEN 'INFO'
       WHEN n >= 5 THEN 'DEBUG' WHEN n >= 1 THEN 'TRACE' ELSE 'UNSPECIFIED' END AS severity_name,
  CAST(CASE level WHEN 'FATAL' THEN 21 WHEN 'fatal' THEN 21 WHEN 'ERROR' THEN 17 WHEN 'error' THEN 17
       WHEN 'WARN' THEN 13 WHEN 'warn' THEN 13 WHEN 'WARNING' THEN 13 WHEN 'warning' THEN 13 WHEN 'INFO' THEN 9 WHEN 'info' THEN 9
       WHEN 'DEBUG' THEN 5 WHEN 'debug' THEN 5 WHEN 'TRACE' THEN 1 WHEN 'trace' THEN 1 ELSE 0 END AS BIGINT) AS parsed,
  n >= 17 AS is_error, event_id % 3 > 0 AS has_trace
FROM l"""


# -- ingest -------------------------------------------------------------------------------------


def _attr(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value"))


def _nano(column: str) -> Column:
    return F.concat(F.unix_micros(column).cast("string"), F.lit("000"))


def trace_requests(spans: DataFrame) -> DataFrame:
    """Spans as nested export requests, one span each."""
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"),
        F.col("operation_name").alias("name"), "kind",
        _nano("start_time").alias("startTimeUnixNano"), _nano("end_time").alias("endTimeUnixNano"),
        F.struct(F.col("status").alias("code"), F.col("status_message").alias("message")).alias("status"),
        F.array(_attr("user", F.col("attributes")["user"]), _attr("props", F.col("attributes")["props"])).alias("attributes"),
    )
    resource = F.struct(F.array(_attr("service.name", F.col("service_name"))).alias("attributes"))
    request = F.struct(
        F.array(
            F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))
        ).alias("resourceSpans")
    )
    return spans.select(F.to_json(request).alias("value"))


def otlp_traces(spark, sf_dir):
    flat = otlp.flatten_otlp_traces(trace_requests(views.spans(spark, sf_dir)))
    return flat.select(
        "trace_id", "span_id", "parent_span_id", "service_name", "operation_name",
        F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "duration_ms",
        F.col("status").cast("bigint").alias("status"), "status_message", F.col("kind").cast("bigint").alias("kind"),
        _attribute("user"), _attribute("props"),
    )


OTLP_TRACES = _spans_sql("""
SELECT trace_id, span_id, parent_span_id, service_name, operation_name, epoch_us(start_time) AS start_us,
  epoch_us(end_time) AS end_us, duration_ms, CAST(status AS BIGINT) AS status, status_message,
  CAST(kind AS BIGINT) AS kind, attr_user, attr_props FROM spans_v""")


def otlp_logs(spark, sf_dir):
    logs = views.logs(spark, sf_dir)
    record = F.struct(
        _nano("timestamp").alias("timeUnixNano"), _nano("observed_timestamp").alias("observedTimeUnixNano"),
        F.col("severity").alias("severityNumber"), F.col("severity_text").alias("severityText"),
        F.struct(F.col("body").alias("stringValue")).alias("body"),
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"),
        F.array(_attr("props", F.col("log_attributes")["props"])).alias("attributes"),
    )
    resource = F.struct(F.array(_attr("service.name", F.col("service_name"))).alias("attributes"))
    request = F.struct(
        F.array(
            F.struct(resource.alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))
        ).alias("resourceLogs")
    )
    flat = otlp.flatten_otlp_logs(logs.select(F.to_json(request).alias("value")))
    return flat.select(
        F.unix_micros("timestamp").alias("at_us"), F.unix_micros("observed_timestamp").alias("observed_us"),
        F.col("severity").cast("bigint").alias("severity"), "severity_text", "body", "service_name", "trace_id", "span_id",
        F.col("log_attributes")["props"].alias("props"),
    )


OTLP_LOGS = f"""WITH logs_v AS ({LOGS_SQL})
SELECT epoch_us(l."timestamp") AS at_us, epoch_us(observed_timestamp) AS observed_us, CAST(severity AS BIGINT) AS severity,
  severity_text, body, service_name, trace_id, span_id, e.props
FROM logs_v l JOIN events e ON l.span_id = 's' || e.event_id"""


def otlp_metrics(spark, sf_dir):
    """Points sent as gauges (double values) and sums (integer values), and flattened again."""
    points = views.metrics(spark, sf_dir).filter(F.col("name") != "item_price")
    attrs = F.array(_attr("type", F.col("labels")["type"]), _attr("shard", F.col("labels")["shard"]))
    point = F.struct(
        _nano("timestamp").alias("timeUnixNano"),
        F.when(F.col("type") == 1, F.col("value")).alias("asDouble"),
        F.when(F.col("type") == 2, F.col("value").cast("bigint").cast("string")).alias("asInt"),
        attrs.alias("attributes"),
    )
    data = F.struct(F.array(point).alias("dataPoints"))
    metric = F.struct("name", F.when(F.col("type") == 1, data).alias("gauge"), F.when(F.col("type") == 2, data).alias("sum"))
    resource = F.struct(F.array(_attr("service.name", F.col("service_name"))).alias("attributes"))
    request = F.struct(
        F.array(
            F.struct(resource.alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))
        ).alias("resourceMetrics")
    )
    flat = otlp.flatten_otlp_metrics(points.select(F.to_json(request).alias("value")))
    return flat.select(
        "name", F.col("type").cast("bigint").alias("type"), F.col("labels")["type"].alias("l_type"),
        F.col("labels")["shard"].alias("l_shard"), "value", F.unix_micros("timestamp").alias("at_us"), "service_name",
    )


OTLP_METRICS = f"""WITH metrics_v AS ({METRICS_SQL})
SELECT name, CAST(type AS BIGINT) AS type, l_type, l_shard, value, epoch_us("timestamp") AS at_us, service_name
FROM metrics_v WHERE name <> 'item_price'"""


def topic_round_trip(spark, sf_dir):
    """Logs as keyed JSON messages, some of them damaged; decoded again, the damaged ones skipped."""
    messages = topics.encode(views.logs(spark, sf_dir), "service_name")
    damaged = F.when(F.col("value").contains("nothing to see"), F.substring("value", 1, 40)).otherwise(F.col("value"))
    decoded = topics.decode_logs(messages.withColumn("value", damaged))
    return decoded.select(
        F.unix_micros("timestamp").alias("at_us"), F.unix_micros("observed_timestamp").alias("observed_us"),
        F.col("severity").cast("bigint").alias("severity"), "body", "service_name", "trace_id", "span_id",
    )


TOPIC_ROUND_TRIP = f"""WITH logs_v AS ({LOGS_SQL})
SELECT epoch_us("timestamp") AS at_us, epoch_us(observed_timestamp) AS observed_us, CAST(severity AS BIGINT) AS severity,
  body, service_name, trace_id, span_id FROM logs_v WHERE body NOT LIKE '%nothing to see%'"""


def series_export(spark, sf_dir):
    exported = topics.sample_export(views.metrics(spark, sf_dir))
    label = F.transform("labels", lambda e: F.concat(e["name"], F.lit("="), e["value"]))
    return exported.select(
        F.array_join(label, ",").alias("labels"),
        F.col("samples")[0]["value"].alias("value"),
        F.col("samples")[0]["timestamp"].alias("ts_ms"),
        F.size("samples").cast("bigint").alias("n"),
    )


SERIES_EXPORT = f"""WITH metrics_v AS ({METRICS_SQL})
SELECT '__name__=' || name || ',shard=' || l_shard || ',type=' || l_type AS labels, value,
  epoch_us("timestamp") // 1000 AS ts_ms, CAST(1 AS BIGINT) AS n FROM metrics_v"""


def retention(spark, sf_dir):
    kept = tables.apply_retention(views.spans(spark, sf_dir), tables.SPANS, END, 7)
    return kept.select("span_id", F.unix_micros("start_time").alias("start_us"))


RETENTION = _spans_sql(f"""
SELECT span_id, epoch_us(start_time) AS start_us FROM spans_v
WHERE date_trunc('second', start_time) + INTERVAL 7 DAY > TIMESTAMP '{END}'""")


def span_days(spark, sf_dir):
    dated = tables.with_date(views.spans(spark, sf_dir), tables.SPANS)
    return dated.groupBy(F.col("_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("spans"))


_SHARE_SQL = "('0x' || substr(md5(trace_id), 1, 8))::BIGINT / 4294967296"

QUERIES = {
    "normalize_service": (normalize_service, NORMALIZE_SERVICE),
    "attr_add": (attr_add, _spans_sql("SELECT span_id, 'production' AS attr_env, attr_user, attr_props FROM spans_v")),
    "attr_remove": (
        attr_remove,
        _spans_sql("SELECT span_id, attr_user, CAST(NULL AS VARCHAR) AS attr_props, CAST(1 AS BIGINT) AS n FROM spans_v"),
    ),
    "attr_rename": (
        attr_rename,
        _spans_sql(
            "SELECT span_id, attr_props AS attr_user, CAST(NULL AS VARCHAR) AS attr_props, "
            "CAST(NULL AS VARCHAR) AS attr_other, CAST(1 AS BIGINT) AS n FROM spans_v"
        ),
    ),
    "attr_hash": (attr_hash, ATTR_HASH),
    "attr_pattern": (
        attr_pattern,
        _spans_sql(
            "SELECT span_id, CASE WHEN regexp_matches(attr_props, '[02468]}$') THEN NULL ELSE attr_props END AS attr_props FROM spans_v"
        ),
    ),
    "log_attributes": (
        log_attributes,
        "SELECT 's' || event_id AS span_id, props AS payload, 'test' AS env, CAST(NULL AS VARCHAR) AS props FROM events",
    ),
    "head_sample": (
        head_sample,
        _spans_sql(
            "SELECT span_id, service_name, CAST(status AS BIGINT) AS status FROM spans_v WHERE status = 2 OR service_name = 'purchase'"
        ),
    ),
    "head_sample_half": (
        head_sample_half, _spans_sql(f"SELECT trace_id, span_id FROM spans_v WHERE status = 2 OR {_SHARE_SQL} < 0.5")
    ),
    "tail_sample": (
        tail_sample,
        _spans_sql(
            f"SELECT trace_id, span_id FROM spans_v WHERE {_SHARE_SQL} < 0.3 "
            "OR trace_id IN (SELECT trace_id FROM spans_v WHERE status = 2)"
        ),
    ),
    "enum_names": (enum_names, ENUM_NAMES),
    "severity_names": (severity_names, SEVERITY_NAMES),
    "otlp_traces": (otlp_traces, OTLP_TRACES),
    "otlp_logs": (otlp_logs, OTLP_LOGS),
    "otlp_metrics": (otlp_metrics, OTLP_METRICS),
    "topic_round_trip": (topic_round_trip, TOPIC_ROUND_TRIP),
    "series_export": (series_export, SERIES_EXPORT),
    "retention": (retention, RETENTION),
    "span_days": (
        span_days,
        _spans_sql("SELECT strftime(start_time, '%Y-%m-%d') AS day, count(*) AS spans FROM spans_v GROUP BY 1"),
    ),
}
