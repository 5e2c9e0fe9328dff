"""Processors: ``DataFrame -> DataFrame`` steps applied to a signal before it is written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from telemill.functions import fields
from telemill.functions.fields import has_error
from telemill.operators.joins import rows_of_keys

# Hash space of sampling decisions: the first 32 bits of the MD5 of the trace id.
SAMPLE_SPACE = 1 << 32


@dataclass(frozen=True)
class AttributeRule:
    """One attribute change.  With ``pattern`` it applies only where the present value matches it."""

    action: str
    key: str
    new_key: str = ""
    value: str = ""
    pattern: str = ""


def _apply(attrs: Column, rule: AttributeRule) -> Column:
    if rule.action == "add":
        changed = fields.add_attribute(attrs, rule.key, rule.value)
    elif rule.action == "remove":
        changed = fields.remove_attribute(attrs, rule.key)
    elif rule.action == "rename":
        changed = fields.rename_attribute(attrs, rule.key, rule.new_key)
    elif rule.action == "hash":
        changed = fields.hash_attribute(attrs, rule.key)
    else:
        raise ValueError(f"unknown attribute action {rule.action!r}")
    if not rule.pattern:
        return changed
    return F.when(F.coalesce(attrs[rule.key].rlike(rule.pattern), F.lit(False)), changed).otherwise(attrs)


def change_attributes(df: DataFrame, rules: Sequence[AttributeRule], column: str = "attributes") -> DataFrame:
    """Apply the rules in order; for logs pass ``column="log_attributes"``."""
    for rule in rules:
        df = df.withColumn(column, _apply(F.col(column), rule))
    return df


def normalize_services(df: DataFrame) -> DataFrame:
    return df.withColumn("service_name", fields.normalize_service_name("service_name"))


def _share(trace_id: str = "trace_id") -> Column:
    """Position of a trace in [0, 1), the same for all its spans and on every run."""
    return F.conv(F.substring(F.md5(trace_id), 1, 8), 16, 10).cast("double") / F.lit(float(SAMPLE_SPACE))


def head_sampled(rate: float, service_rates: Mapping[str, float] | None = None) -> Column:
    """Errors always; else by the service's own rate where there is one, else by the global rate."""
    wanted = F.lit(float(rate))
    if service_rates:
        own = F.create_map(*[F.lit(x) for kv in service_rates.items() for x in (kv[0], float(kv[1]))])
        wanted = F.coalesce(own[F.col("service_name")], wanted)
    return has_error() | (_share() < wanted)


def head_sample(spans: DataFrame, rate: float, service_rates: Mapping[str, float] | None = None) -> DataFrame:
    """Sample spans by a hash of the trace id: no shuffle, and spans of equal rate stay together."""
    return spans.filter(head_sampled(rate, service_rates))


def tail_sample(spans: DataFrame, rate: float) -> DataFrame:
    """Keep whole traces: all with an error, and a ``rate`` share of the others.

    Traces chosen by their hash need no look at their other spans; only the rest is matched against the
    ids of its failed traces.
    """
    chosen = _share() < F.lit(float(rate))
    rest = spans.filter(~chosen)
    failed = rows_of_keys(rest, rest.filter(has_error()), "trace_id", ["span_id", "start_time"])
    return spans.filter(chosen).unionByName(failed)


def run_processors(df: DataFrame, processors: Sequence) -> DataFrame:
    """Apply ``DataFrame -> DataFrame`` steps in order."""
    for step in processors:
        df = df.transform(step)
    return df
