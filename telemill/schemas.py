"""Fixed table schemas of the three signals, their special points and the alerting tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

TEXT, LONG, INT, DOUBLE = StringType(), LongType(), IntegerType(), DoubleType()
FLAG, TIME, STR_MAP = BooleanType(), TimestampType(), MapType(StringType(), StringType())


def _row(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


SPAN_EVENT = _row(timestamp=TIME, name=TEXT, attributes=STR_MAP)
SPAN_LINK = _row(trace_id=TEXT, span_id=TEXT, trace_state=TEXT, attributes=STR_MAP)

SPAN_SCHEMA = _row(
    trace_id=TEXT,
    span_id=TEXT,
    parent_span_id=TEXT,
    trace_state=TEXT,
    service_name=TEXT,
    operation_name=TEXT,
    start_time=TIME,
    end_time=TIME,
    duration_ms=LONG,
    status=INT,
    status_message=TEXT,
    kind=INT,
    attributes=STR_MAP,
    resource_attributes=STR_MAP,
    events=ArrayType(SPAN_EVENT),
    links=ArrayType(SPAN_LINK),
)

LOG_SCHEMA = _row(
    timestamp=TIME,
    observed_timestamp=TIME,
    severity=INT,
    severity_text=TEXT,
    body=TEXT,
    service_name=TEXT,
    trace_id=TEXT,
    span_id=TEXT,
    trace_flags=LONG,
    resource_attributes=STR_MAP,
    log_attributes=STR_MAP,
    structured_fields=STR_MAP,
)

METRIC_SCHEMA = _row(
    name=TEXT,
    description=TEXT,
    unit=TEXT,
    type=INT,
    labels=STR_MAP,
    value=DOUBLE,
    timestamp=TIME,
    service_name=TEXT,
)

# Histogram points carry the metric columns plus their own.
HISTOGRAM_SCHEMA = StructType(
    METRIC_SCHEMA.fields
    + _row(
        count=LONG, sum=DOUBLE, bucket_counts=ArrayType(LONG), explicit_bounds=ArrayType(DOUBLE), min=DOUBLE, max=DOUBLE
    ).fields
)
CONDITION = _row(type=TEXT, operator=TEXT, threshold=DOUBLE)

RULE_SCHEMA = _row(
    name=TEXT,
    expression=TEXT,
    duration_s=LONG,
    severity=TEXT,
    enabled=FLAG,
    labels=STR_MAP,
    annotations=STR_MAP,
    conditions=ArrayType(CONDITION),
    notification_channels=ArrayType(TEXT),
)
RULE_GROUP_SCHEMA = _row(name=TEXT, rules=ArrayType(RULE_SCHEMA))

MATCHER = _row(name=TEXT, value=TEXT, is_regex=FLAG, is_equal=FLAG)
SILENCE_SCHEMA = _row(
    id=TEXT,
    matchers=ArrayType(MATCHER),
    starts_at=TIME,
    ends_at=TIME,
    created_by=TEXT,
    comment=TEXT,
    updated_at=TIME,
    deleted=FLAG,
)

CHANNEL_SCHEMA = _row(channel=TEXT, repeat_interval_s=LONG)
