"""Instants, buckets and tick grids, all in whole microseconds since the epoch."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

MICROS = 1_000_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def long_lit(value: int) -> Column:
    """A 64-bit literal: Python integers that fit become 32-bit ones, whose products overflow."""
    return F.lit(value).cast("bigint")


def micros(instant: datetime | date | str | int) -> int:
    """Microseconds since the epoch.  Values without a zone are UTC; integers are micros already."""
    if isinstance(instant, int):
        return instant
    if isinstance(instant, str):
        instant = datetime.fromisoformat(instant)
    if not isinstance(instant, datetime):
        instant = datetime(instant.year, instant.month, instant.day)
    if instant.tzinfo is None:
        instant = instant.replace(tzinfo=timezone.utc)
    return (instant - _EPOCH) // timedelta(microseconds=1)


def ts_lit(instant: datetime | date | str | int) -> Column:
    """A timestamp literal; it folds to a constant, so filters on it reach the scan."""
    return F.timestamp_micros(long_lit(micros(instant)))


def date_lit(instant: datetime | date | str | int) -> Column:
    return F.lit((_EPOCH + timedelta(microseconds=micros(instant))).date())


def within(column: str, start, end) -> Column:
    """Inclusive range on a timestamp column."""
    return F.col(column).between(ts_lit(start), ts_lit(end))


def prune_days(df, column: str, start, end):
    """Inclusive time filter plus, on tables laid out by day, the partition filter it implies."""
    kept = df.filter(within(column, start, end))
    if "_date" in df.columns:
        kept = kept.filter(F.col("_date").between(date_lit(start), date_lit(end)))
    return kept


def bucket_start(column: Column, seconds: int) -> Column:
    """Start of the ``seconds`` wide bucket, aligned to the epoch."""
    width = long_lit(seconds * MICROS)
    at = F.unix_micros(column)
    return F.timestamp_micros(at - F.pmod(at, width))


def floor_div(value: Column, width: Column | int) -> Column:
    """Integer division rounding down, also for negative values (``div`` alone rounds towards zero)."""
    width = long_lit(width) if isinstance(width, int) else width
    return F.call_function("div", value - F.pmod(value, width), width)


def ceil_div(value: Column, width: Column | int) -> Column:
    return -floor_div(-value, width)
