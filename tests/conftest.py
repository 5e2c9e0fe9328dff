import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from telemill import build_session  # noqa: E402
from telemill.schemas import LOG_SCHEMA, METRIC_SCHEMA, SPAN_SCHEMA  # noqa: E402

T0 = datetime(2024, 1, 1, 12, 0, 0, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(seconds: float = 0) -> datetime:
    return T0 + timedelta(seconds=seconds)


def frame(spark, schema, rows):
    """Rows given as dicts; columns left out are null."""
    names = schema.fieldNames()
    for row in rows:
        assert set(row) <= set(names), set(row) - set(names)
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)


def span(trace, span_id, parent="", service="svc", ms=1, status=0, start=0.0, **more):
    row = dict(
        trace_id=trace, span_id=span_id, parent_span_id=parent, trace_state="", service_name=service, operation_name="op",
        start_time=at(start), end_time=at(start + ms / 1000), duration_ms=ms, status=status, status_message="", kind=0,
        attributes={}, resource_attributes={},
    )
    return {**row, **more}


def spans(spark, *rows):
    return frame(spark, SPAN_SCHEMA, rows)


def log(body="", severity=9, service="svc", seconds=0.0, **more):
    row = dict(
        timestamp=at(seconds), observed_timestamp=at(seconds), severity=severity, severity_text="", body=body,
        service_name=service, trace_id="", span_id="", trace_flags=0, resource_attributes={}, log_attributes={},
    )
    return {**row, **more}


def logs(spark, *rows):
    return frame(spark, LOG_SCHEMA, rows)


def point(name, value, seconds=0.0, service="svc", type=1, **labels):
    return dict(
        name=name, description="", unit="", type=type, labels=labels, value=float(value), timestamp=at(seconds),
        service_name=service,
    )


def points(spark, *rows):
    return frame(spark, METRIC_SCHEMA, rows)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
