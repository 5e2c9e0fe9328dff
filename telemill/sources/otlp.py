"""Nested export requests (OTLP/JSON: resource > scope > record) to flat rows of the three signals.

Every function maps a DataFrame with one request per row in a JSON text column to a DataFrame of rows,
for batches and streams alike.  There is no shuffle: explode, project, done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# An attribute value holds one of several kinds.  Kinds nested deeper than one level stay JSON text.
_SCALAR = "stringValue: string, boolValue: boolean, intValue: string, doubleValue: double, bytesValue: string"
_NESTED = f"{_SCALAR}, arrayValue: string, kvlistValue: string"
_VALUE = (
    f"struct<{_SCALAR}, arrayValue: struct<values: array<struct<{_NESTED}>>>, "
    f"kvlistValue: struct<values: array<struct<key: string, value: struct<{_NESTED}>>>>>"
)
_ATTRS = f"array<struct<key: string, value: {_VALUE}>>"
_RESOURCE = f"resource: struct<attributes: {_ATTRS}>"
_STATUS = "struct<code: int, message: string>"
_EVENT = f"struct<timeUnixNano: string, name: string, attributes: {_ATTRS}>"
_LINK = f"struct<traceId: string, spanId: string, traceState: string, attributes: {_ATTRS}>"
_SPAN = (
    "struct<traceId: string, spanId: string, parentSpanId: string, traceState: string, name: string, kind: int, "
    f"startTimeUnixNano: string, endTimeUnixNano: string, status: {_STATUS}, attributes: {_ATTRS}, "
    f"events: array<{_EVENT}>, links: array<{_LINK}>>"
)
TRACES_REQUEST = f"resourceSpans array<struct<{_RESOURCE}, scopeSpans: array<struct<spans: array<{_SPAN}>>>>>"

_LOG = (
    "struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: int, severityText: string, "
    f"body: {_VALUE}, traceId: string, spanId: string, flags: bigint, attributes: {_ATTRS}>"
)
LOGS_REQUEST = f"resourceLogs array<struct<{_RESOURCE}, scopeLogs: array<struct<logRecords: array<{_LOG}>>>>>"

_NUMBER_POINT = f"struct<timeUnixNano: string, asDouble: double, asInt: string, attributes: {_ATTRS}>"
_HISTOGRAM_POINT = (
    f"struct<timeUnixNano: string, count: string, sum: double, bucketCounts: array<string>, "
    f"explicitBounds: array<double>, min: double, max: double, attributes: {_ATTRS}>"
)
_METRIC = (
    "struct<name: string, description: string, unit: string, "
    f"gauge: struct<dataPoints: array<{_NUMBER_POINT}>>, sum: struct<dataPoints: array<{_NUMBER_POINT}>>, "
    f"histogram: struct<dataPoints: array<{_HISTOGRAM_POINT}>>>"
)
METRICS_REQUEST = f"resourceMetrics array<struct<{_RESOURCE}, scopeMetrics: array<struct<metrics: array<{_METRIC}>>>>>"

GAUGE, COUNTER, HISTOGRAM = 1, 2, 3


# The value expressions are SQL text: they repeat for every attribute list, and as text each reaches the
# JVM in one call.  Arguments are column paths or lambda variables.


def _number_sql(d: str) -> str:
    """Whole doubles are written without a fraction, as JSON encoders do."""
    whole = f"{d} = floor({d}) AND abs({d}) < 1e15"
    return f"if({whole}, cast(floor({d}) AS string), cast({d} AS string))"


def _quote_sql(text: str) -> str:
    """JSON string literal of a text, cut out of a one-field object."""
    wrapped = f"to_json(named_struct('t', {text}))"
    return f"substr({wrapped}, 6, length({wrapped}) - 6)"


def _nested_sql(v: str) -> str:
    """JSON text of a value inside a list."""
    quoted = f"coalesce({v}.stringValue, {v}.bytesValue)"
    return (
        f"coalesce(if({quoted} IS NOT NULL, {_quote_sql(quoted)}, NULL), cast({v}.boolValue AS string), {v}.intValue, "
        f"{_number_sql(v + '.doubleValue')}, {v}.arrayValue, {v}.kvlistValue, 'null')"
    )


def _value_sql(v: str) -> str:
    pairs = f"transform({v}.kvlistValue.values, p -> named_struct('k', p.key, 'j', {_nested_sql('p.value')}))"
    return (
        f"coalesce({v}.stringValue, cast({v}.boolValue AS string), {v}.intValue, "
        f"{_number_sql(v + '.doubleValue')}, {v}.bytesValue, "
        f"concat('[', array_join(transform({v}.arrayValue.values, m -> {_nested_sql('m')}), ','), ']'), "
        f"concat('{{', array_join(transform(sort_array({pairs}), q -> concat({_quote_sql('q.k')}, ':', q.j)), ','), '}}'), "
        "'')"
    )


def _attrs_sql(attrs: str) -> str:
    keys = f"transform({attrs}, k -> k.key)"
    # Keys are unique in well-formed requests, so the search for later equals is the rare branch.
    last = f"filter({attrs}, (a, i) -> NOT array_contains(slice({keys}, i + 2, size({attrs})), a.key))"
    items = f"if(size(array_distinct({keys})) = size({attrs}), {attrs}, {last})"
    entry = f"named_struct('key', a.key, 'value', {_value_sql('a.value')})"
    return f"if(size({attrs}) > 0, map_from_entries(transform({items}, a -> {entry})), NULL)"


def _time_sql(text: str) -> str:
    """Unix nanoseconds as a timestamp, cut to microseconds."""
    return f"timestamp_micros(coalesce(try_cast({text} AS bigint), 0) div 1000)"


def value_text(path: str) -> Column:
    """Any attribute value as text: lists and key/value lists as JSON, no value as the empty string."""
    return F.expr(_value_sql(path))


def attrs_to_map(path: str) -> Column:
    """Attribute list to map<string,string>; an empty list gives null, a repeated key keeps its last value."""
    return F.expr(_attrs_sql(path))


def _service(resource: str) -> Column:
    """``service.name`` of the resource where it is a string, else the empty string."""
    found = f"filter({resource}.attributes, a -> a.key = 'service.name')"
    return F.expr(f"coalesce(try_element_at({found}, 1).value.stringValue, '')")


def _nanos(path: str) -> Column:
    return F.coalesce(F.col(path).try_cast("bigint"), F.lit(0).cast("bigint"))


def _time(path: str) -> Column:
    return F.expr(_time_sql(path))


def _text(path: str) -> Column:
    return F.coalesce(path, F.lit(""))


def _id(path: str) -> Column:
    return F.lower(_text(path))


def _parsed(df: DataFrame, column: str, schema: str, root: str) -> DataFrame:
    request = F.from_json(F.col(column), schema)
    return df.select(F.explode(request[root]).alias("r"))


def rejected_requests(df: DataFrame, schema: str, root: str, column: str = "value") -> DataFrame:
    """Requests that the flattening functions leave out: the message and a reason.

    ``schema`` and ``root`` are those of the signal, for instance ``TRACES_REQUEST`` and ``resourceSpans``.
    """
    body = F.col(column)
    reason = (
        F.when(body.isNull(), "no message")
        .when(F.get_json_object(body, "$").isNull(), "not JSON")
        .when(F.from_json(body, schema)[root].isNull(), f"no {root}")
    )
    return df.select(body.alias("message"), reason.alias("reason")).filter(F.col("reason").isNotNull())


def flatten_otlp_traces(df: DataFrame, column: str = "value") -> DataFrame:
    """Trace export requests to spans, with events, links and trace state."""
    spans = (
        _parsed(df, column, TRACES_REQUEST, "resourceSpans")
        .select("r.resource", F.explode("r.scopeSpans").alias("scope"))
        .select("resource", F.explode("scope.spans").alias("s"))
    )
    start, end = "s.startTimeUnixNano", "s.endTimeUnixNano"
    events = (
        f"transform(s.events, e -> named_struct('timestamp', {_time_sql('e.timeUnixNano')}, "
        f"'name', coalesce(e.name, ''), 'attributes', {_attrs_sql('e.attributes')}))"
    )
    links = (
        "transform(s.links, l -> named_struct('trace_id', lower(coalesce(l.traceId, '')), "
        "'span_id', lower(coalesce(l.spanId, '')), 'trace_state', coalesce(l.traceState, ''), "
        f"'attributes', {_attrs_sql('l.attributes')}))"
    )
    return spans.select(
        _id("s.traceId").alias("trace_id"),
        _id("s.spanId").alias("span_id"),
        _id("s.parentSpanId").alias("parent_span_id"),
        _text("s.traceState").alias("trace_state"),
        _service("resource").alias("service_name"),
        _text("s.name").alias("operation_name"),
        _time(start).alias("start_time"),
        _time(end).alias("end_time"),
        F.call_function("div", _nanos(end) - _nanos(start), F.lit(1_000_000)).alias("duration_ms"),
        F.coalesce("s.status.code", F.lit(0)).alias("status"),
        _text("s.status.message").alias("status_message"),
        F.coalesce("s.kind", F.lit(0)).alias("kind"),
        attrs_to_map("s.attributes").alias("attributes"),
        attrs_to_map("resource.attributes").alias("resource_attributes"),
        F.expr(events).alias("events"),
        F.expr(links).alias("links"),
    )


def flatten_otlp_logs(df: DataFrame, column: str = "value") -> DataFrame:
    """Log export requests to log records; any body becomes text."""
    logs = (
        _parsed(df, column, LOGS_REQUEST, "resourceLogs")
        .select("r.resource", F.explode("r.scopeLogs").alias("scope"))
        .select("resource", F.explode("scope.logRecords").alias("l"))
    )
    return logs.select(
        _time("l.timeUnixNano").alias("timestamp"),
        F.when(_nanos("l.observedTimeUnixNano") != 0, _time("l.observedTimeUnixNano")).alias(
            "observed_timestamp"
        ),
        F.coalesce("l.severityNumber", F.lit(0)).alias("severity"),
        _text("l.severityText").alias("severity_text"),
        value_text("l.body").alias("body"),
        _service("resource").alias("service_name"),
        _id("l.traceId").alias("trace_id"),
        _id("l.spanId").alias("span_id"),
        F.coalesce("l.flags", F.lit(0)).cast("bigint").alias("trace_flags"),
        attrs_to_map("resource.attributes").alias("resource_attributes"),
        attrs_to_map("l.attributes").alias("log_attributes"),
        F.lit(None).cast("map<string, string>").alias("structured_fields"),
    )


def _metrics(df: DataFrame, column: str) -> DataFrame:
    return (
        _parsed(df, column, METRICS_REQUEST, "resourceMetrics")
        .select(_service("r.resource").alias("service_name"), F.explode("r.scopeMetrics").alias("scope"))
        .select("service_name", F.explode("scope.metrics").alias("m"))
    )


def _point_columns(kind: Column) -> list[Column]:
    return [
        F.col("m.name").alias("name"),
        _text("m.description").alias("description"),
        _text("m.unit").alias("unit"),
        kind.alias("type"),
        attrs_to_map("p.attributes").alias("labels"),
    ]


def flatten_otlp_metrics(df: DataFrame, column: str = "value") -> DataFrame:
    """Metric export requests to points: gauges and sums, integer and double values.

    The points of a metric are tagged with their type and exploded together, so the input is read once.
    """
    none = F.array().cast(f"array<struct<type: int, p: {_NUMBER_POINT}>>")

    def tagged_points(kind: str, code: int) -> Column:
        return F.coalesce(
            F.transform(f"m.{kind}.dataPoints", lambda p: F.struct(F.lit(code).alias("type"), p.alias("p"))), none
        )

    tagged = F.concat(tagged_points("gauge", GAUGE), tagged_points("sum", COUNTER))
    points = _metrics(df, column).select("service_name", "m", F.explode(tagged).alias("t"))
    points = points.select("service_name", "m", F.col("t.type").alias("kind"), F.col("t.p").alias("p"))
    return points.select(
        *_point_columns(F.col("kind")),
        F.coalesce("p.asDouble", F.col("p.asInt").try_cast("double"), F.lit(0.0)).alias("value"),
        _time("p.timeUnixNano").alias("timestamp"),
        "service_name",
    )


def flatten_otlp_histograms(df: DataFrame, column: str = "value") -> DataFrame:
    """Histogram points of metric export requests; ``value`` is their sum."""
    points = _metrics(df, column).select("service_name", "m", F.explode("m.histogram.dataPoints").alias("p"))
    return points.select(
        *_point_columns(F.lit(HISTOGRAM)),
        F.coalesce("p.sum", F.lit(0.0)).alias("value"),
        _time("p.timeUnixNano").alias("timestamp"),
        "service_name",
        F.coalesce(F.col("p.count").try_cast("bigint"), F.lit(0)).alias("count"),
        F.coalesce("p.sum", F.lit(0.0)).alias("sum"),
        F.transform("p.bucketCounts", lambda c: c.try_cast("bigint")).alias("bucket_counts"),
        F.col("p.explicitBounds").alias("explicit_bounds"),
        F.col("p.min").alias("min"),
        F.col("p.max").alias("max"),
    )
