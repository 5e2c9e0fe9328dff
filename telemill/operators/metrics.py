"""Metric selection, rollups, series listings and vector functions.

A listed series is a metric name and a label set.  Maps cannot be join or window keys, so inside a plan
the label set travels as ``series``: its entries sorted by key, an array that Spark can hash and order.
``map_from_entries`` turns it back into labels.

Vector functions keep the services apart, as rollups do: equal labels of two services are two series, and
their counters must not be read as one.  There ``series`` ends with the reserved label ``__service__``;
``aggregate_series`` merges services unless that label is kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from telemill.functions.fields import MATCH_OPERATORS, matches_label, series_key, service_series, sorted_labels
from telemill.functions.timegrid import MICROS, bucket_start, long_lit, micros, prune_days
from telemill.operators import sliding

DEFAULT_SERIES = 1_000
DEFAULT_VALUES = 1_000

Matcher = tuple[str, str, str]  # (label, operator, value)

ROLLUP_SECONDS = {"5m": 300, "1h": 3600, "1d": 86400}
WINDOW_SECONDS = {"1m": 60, **ROLLUP_SECONDS}
ROLLUP_KEYS = ["name", "description", "unit", "type", "labels", "service_name"]


def with_series(points: DataFrame) -> DataFrame:
    return points.withColumn("series", sorted_labels())


def with_service_series(points: DataFrame) -> DataFrame:
    """``series`` of a vector: the labels, then the service where the points have one."""
    return points.withColumn("series", service_series() if "service_name" in points.columns else sorted_labels())


def top(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows; None, zero or less mean all."""
    return rows.limit(limit) if limit and limit > 0 else rows


def _labelled(vector: DataFrame) -> DataFrame:
    """Replace ``series`` by the label map and its canonical text."""
    labels = F.map_from_entries("series")
    return vector.withColumn("labels", labels).withColumn("series_key", F.to_json(labels)).drop("series")


# -- selection ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Selector:
    """Which points a query means: one metric, label matchers, optionally one service."""

    name: str
    matchers: Sequence[Matcher] = field(default_factory=tuple)
    service: str = ""

    def condition(self) -> Column:
        chosen = F.col("name") == self.name
        for key, op, value in self.matchers:
            chosen &= matches_label("labels", key, op, value)
        if self.service:
            chosen &= F.col("service_name") == self.service
        return chosen

    def is_valid(self) -> bool:
        return bool(self.name) and all(op in MATCH_OPERATORS for _, op, _ in self.matchers)


def tag_selected(points: DataFrame, selectors: Mapping[str, Selector], column: str) -> DataFrame:
    """Points wanted by any selector, once per selector that wants them, its name in ``column``.

    One scan serves all selectors; the metric names are a plain filter that reaches it.
    """
    wanted = F.array_compact(F.array(*[F.when(s.condition(), F.lit(name)) for name, s in selectors.items()]))
    names = sorted({s.name for s in selectors.values()})
    return points.filter(F.col("name").isin(*names)).withColumn(column, F.explode(wanted))


def select_points(points: DataFrame, selector: Selector, start, end, *, limit: int | None = None) -> DataFrame:
    """Points of a selector in ``[start, end]``, oldest first; all of them unless a limit is given."""
    found = (
        prune_days(points, "timestamp", start, end)
        .filter(selector.condition())
        .withColumn("series_key", series_key())
        .orderBy("timestamp", "series_key", "service_name", "value")
    )
    return top(found, limit)


def select_resolution(range_seconds: float) -> str:
    """Resolution a range is answered from: at least a day, six hours, more than one hour, else raw."""
    if range_seconds >= 24 * 3600:
        return "1d"
    if range_seconds >= 6 * 3600:
        return "1h"
    if range_seconds > 3600:
        return "5m"
    return "1m"


def routed_points(tables: Mapping[str, DataFrame], start, end) -> DataFrame:
    """The frame that answers ``[start, end]``: raw points under ``"1m"``, rollups under their size.

    Rollup rows carry their bucket start as timestamp, so a bucket begun before ``start`` is left out.
    """
    resolution = select_resolution((micros(end) - micros(start)) // MICROS)
    frame = tables[resolution]
    return frame if resolution == "1m" else read_rollup(frame)


# -- rollups ------------------------------------------------------------------------------------


def rollup(points: DataFrame, size: str) -> DataFrame:
    """Downsample raw points to buckets holding sum and count, which merge without loss."""
    return points.groupBy(*ROLLUP_KEYS, bucket_start(F.col("timestamp"), ROLLUP_SECONDS[size]).alias("bucket")).agg(
        F.sum("value").alias("value_sum"), F.count("value").alias("value_cnt")
    )


def merge_rollup(states: DataFrame, size: str) -> DataFrame:
    """Coarser (or same-size) buckets from finer ones; sums and counts add up, averages never do."""
    return states.groupBy(*ROLLUP_KEYS, bucket_start(F.col("bucket"), ROLLUP_SECONDS[size]).alias("bucket")).agg(
        F.sum("value_sum").alias("value_sum"), F.sum("value_cnt").alias("value_cnt")
    )


def read_rollup(states: DataFrame) -> DataFrame:
    """Rollup rows as metric points whose value is the bucket average."""
    return states.select(
        *ROLLUP_KEYS,
        F.try_divide("value_sum", "value_cnt").alias("value"),
        F.col("bucket").alias("timestamp"),
    )


def multi_window_aggregate(points: DataFrame, sizes: Mapping[str, int] | None = None) -> DataFrame:
    """sum, count, min, max and average per series, service and tumbling window, for several sizes.

    The raw points are aggregated once, to the finest size; only those states are copied to the coarser
    windows and merged.  Every size must be a multiple of the finest.
    """
    sizes = dict(sizes or WINDOW_SECONDS)
    finest = min(sizes.values())
    if any(seconds % finest for seconds in sizes.values()):
        raise ValueError("every window size must be a multiple of the finest one")
    keys = ["name", "service_name", "labels"]
    states = points.groupBy(*keys, bucket_start(F.col("timestamp"), finest).alias("fine")).agg(
        F.sum("value").alias("sum"),
        F.count("value").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    windows = F.array(
        *[
            F.struct(F.lit(size).alias("size"), bucket_start(F.col("fine"), seconds).alias("bucket"))
            for size, seconds in sizes.items()
        ]
    )
    return (
        states.withColumn("w", F.explode(windows))
        .groupBy(*keys, F.col("w.size").alias("window_size"), F.col("w.bucket").alias("bucket"))
        .agg(
            F.sum("sum").alias("sum"),
            F.sum("count").alias("count"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
        )
        .withColumn("avg", F.try_divide("sum", "count"))
    )


# -- listings -----------------------------------------------------------------------------------


def list_series(points: DataFrame, prefix: str = "", limit: int | None = DEFAULT_SERIES) -> DataFrame:
    """Distinct (name, labels) with the name prefix, taken literally; no limit (None, 0) means all."""
    return (
        with_series(points.filter(F.col("name").startswith(prefix)))
        .select("name", "series")
        .distinct()
        .orderBy("name", "series")
        .transform(top, limit)
        .transform(_labelled)
    )


def list_labels(points: DataFrame, name: str) -> DataFrame:
    """Distinct label names of a metric."""
    return (
        points.filter(F.col("name") == name)
        .select(F.explode(F.map_keys("labels")).alias("label"))
        .distinct()
        .orderBy("label")
    )


def list_label_values(points: DataFrame, name: str, key: str, limit: int | None = DEFAULT_VALUES) -> DataFrame:
    """Distinct non-empty values of one label of a metric, sorted; no limit (None, 0) means all."""
    return (
        points.filter(F.col("name") == name)
        .select(F.col("labels")[key].alias("label_value"))
        .filter(F.col("label_value") != "")
        .distinct()
        .orderBy("label_value")
        .transform(top, limit)
    )


def search_metric_names(points: DataFrame, prefix: str = "") -> DataFrame:
    """Distinct metric names with the prefix."""
    return points.select("name").filter(F.col("name").startswith(prefix)).distinct().orderBy("name")


# -- result shapes ------------------------------------------------------------------------------


def _metric_map() -> Column:
    """The labels with the metric name under ``__name__``; a label of that name does not hide it."""
    labels = F.coalesce("labels", F.create_map().cast("map<string, string>"))
    own = F.when(F.map_contains_key(labels, "__name__"), F.map_filter(labels, lambda k, _: k != "__name__")).otherwise(
        labels
    )
    return F.map_concat(F.create_map(F.lit("__name__"), F.col("name")), own)


def matrix_samples(points: DataFrame) -> DataFrame:
    """Matrix in long form: a row per sample, ordered by series and time.

    Series metadata is the label map plus ``__name__``.  The order comes from a range-partitioned sort,
    so a series of any length is spread over tasks.
    """
    return (
        with_series(points)
        .select("name", "series", "timestamp", "value")
        .orderBy("name", "series", "timestamp", "value")
        .transform(_labelled)
        .select(_metric_map().alias("metric"), "name", "series_key", F.unix_seconds("timestamp").alias("ts"), "value")
    )


def stepped_samples(points: DataFrame, start, end, step_s: int) -> DataFrame:
    """Matrix on a step grid in long form: the latest sample of each series (and service) in each step.

    A row per step, so ranges of any length are spread over tasks.
    """
    return instant_vector(prune_days(points, "timestamp", start, end), step_s)


def query_matrix(points: DataFrame, start, end, step_s: int) -> DataFrame:
    """:func:`stepped_samples` in array form: per series one ``[ts, value]`` pair for each step that has samples.

    An array has at most one pair per step of the range asked for.
    """
    stepped = stepped_samples(points, start, end, step_s)
    return (
        stepped.groupBy("name", "series")
        .agg(
            F.sort_array(F.collect_list(F.struct(F.unix_seconds("timestamp").alias("ts"), "value"))).alias("values")
        )
        .transform(_labelled)
        .withColumn("metric", _metric_map())
        .select("metric", "name", "series_key", "values")
    )


def dashboard_series(points: DataFrame, targets: Mapping[str, Selector], start, end) -> DataFrame:
    """Samples for several dashboard targets in one scan: target, series, value, epoch milliseconds.

    Invalid targets are skipped.  Milliseconds are whole seconds times 1000.
    """
    valid = {name: s for name, s in targets.items() if s.is_valid()}
    return (
        prune_days(points, "timestamp", start, end)
        .transform(tag_selected, valid, "target")
        .select(
            "target",
            "name",
            series_key().alias("series_key"),
            "value",
            (F.unix_seconds("timestamp") * 1000).alias("ts_ms"),
        )
        .orderBy("target", "series_key", "ts_ms", "value")
    )


# -- vector functions ---------------------------------------------------------------------------
# A vector has columns name, series, timestamp, value.


def instant_vector(points: DataFrame, step_s: int) -> DataFrame:
    """Latest sample of every series in every step; the timestamp is the start of the step."""
    if "series" not in points.columns:
        points = with_service_series(points)
    return (
        points.groupBy("name", "series", bucket_start(F.col("timestamp"), step_s).alias("step"))
        .agg(F.max(F.struct("timestamp", "value")).alias("latest"))
        .select("name", "series", F.col("step").alias("timestamp"), F.col("latest.value").alias("value"))
    )


def rate(points: DataFrame, range_s: int, step_s: int, start, end) -> DataFrame:
    """Per-second increase of each series over ``[tick - range, tick]`` at every tick.

    Ticks are the multiples of ``step`` in ``[start, end]``.  A value below its predecessor is a counter
    reset and counts in full.  The rate is increase / (last time - first time); fewer than two samples
    or no time between them give no row; nothing is extrapolated.

    The increase is the difference of two running totals of the reset-corrected counter, at the first and the last
    sample a tick sees (:mod:`telemill.operators.sliding`); rows grow with ticks, not with range / step.
    """
    step_us, range_us = step_s * MICROS, range_s * MICROS
    first, last = micros(start), micros(end)
    seen = prune_days(points, "timestamp", first - range_us, last)
    seen = with_service_series(seen).withColumn("at", F.unix_micros("timestamp")).select("name", "series", long_lit(range_us).alias("range_us"), "at", "value")
    samples = sliding.linked(sliding.visible(seen, step_us, first, last), ["name", "series"]).withColumn("range_us", long_lit(range_us))
    ticks = sliding.at_ticks(samples, ["name", "series"], step_us, first, last)
    seconds = (F.col("last_at") - F.col("first_at")) / F.lit(float(MICROS))
    return ticks.filter(F.col("last_at") > F.col("first_at")).select(
        "name", "series", F.timestamp_micros("tick_us").alias("timestamp"), (F.col("up") / seconds).alias("value")
    )


def aggregate_series(vector: DataFrame, function: str, by: Sequence[str] = ()) -> DataFrame:
    """``sum`` or ``avg`` over series at each timestamp, keeping the labels in ``by``."""
    aggregate = {"sum": F.sum, "avg": F.avg}[function]
    kept = F.filter("series", lambda e: e["key"].isin(*by)) if by else F.slice("series", 1, 0)
    return (
        vector.select("name", kept.alias("series"), "timestamp", "value")
        .groupBy("name", "series", "timestamp")
        .agg(aggregate("value").alias("value"))
    )


def histogram_buckets(histograms: DataFrame) -> DataFrame:
    """Histogram points as a vector of cumulative bucket counts with an ``le`` label."""
    n = F.size("bucket_counts")
    bounds = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.coalesce(F.try_element_at("explicit_bounds", i).cast("string"), F.lit("+Inf")).alias("le"),
            F.aggregate(F.slice("bucket_counts", 1, i), F.lit(0).cast("bigint"), lambda a, c: a + c).alias("value"),
        ),
    )
    return (
        with_service_series(histograms.filter(n > 0))
        .withColumn("b", F.explode(bounds))
        .select(
            "name",
            F.sort_array(
                F.array_append("series", F.struct(F.lit("le").alias("key"), F.col("b.le").alias("value")))
            ).alias("series"),
            "timestamp",
            F.col("b.value").cast("double").alias("value"),
        )
    )


def histogram_quantile(vector: DataFrame, q: float | Sequence[float]) -> DataFrame:
    """Quantile from cumulative buckets labelled ``le``, per remaining label set and timestamp.

    Several quantiles are one pass over the buckets, and come with a column ``q``.

    rank = q * count of the +Inf bucket; the first bucket reaching the rank is interpolated linearly from
    the bucket below it (0 below the first).  In the +Inf bucket the highest finite bound is returned.
    No samples, or no +Inf bucket, give null.
    """
    le_text = F.element_at(F.filter("series", lambda e: e["key"] == "le"), 1)["value"]
    le = F.when(le_text.isin("+Inf", "Inf"), F.lit(float("inf"))).otherwise(le_text.try_cast("double"))
    keys = ["name", "series", "timestamp"]
    buckets = (
        vector.filter(F.exists("series", lambda e: e["key"] == "le"))
        .select(
            "name",
            le.alias("le"),
            F.filter("series", lambda e: e["key"] != "le").alias("series"),
            "timestamp",
            F.col("value").alias("upto"),
        )
        .filter(F.col("le").isNotNull())
        .groupBy(*keys, "le")
        .agg(F.max("upto").alias("upto"))
    )
    by_bound = Window.partitionBy(*keys).orderBy("le")
    infinite = F.col("le") == float("inf")
    ranked = (
        buckets.withColumn("below", F.coalesce(F.lag("upto").over(by_bound), F.lit(0.0)))
        .withColumn("floor", F.coalesce(F.lag("le").over(by_bound), F.lit(0.0)))
        .withColumn("total", F.max(F.when(infinite, F.col("upto"))).over(Window.partitionBy(*keys)))
        .withColumn("q", F.explode(F.array(*[F.lit(float(x)) for x in ([q] if isinstance(q, (int, float)) else q)])))
        .withColumn("rank", F.col("q") * F.col("total"))
    )
    single = isinstance(q, (int, float))
    hit = F.min(F.when(F.col("upto") >= F.col("rank"), F.struct("le", "floor", "below", "upto", "rank", "total")))
    inside = F.coalesce(
        F.try_divide(F.col("hit.rank") - F.col("hit.below"), F.col("hit.upto") - F.col("hit.below")), F.lit(0.0)
    )
    return (
        ranked.groupBy(*keys, "q")
        .agg(hit.alias("hit"), F.max(F.when(~infinite, F.col("le"))).alias("top"))
        .select(
            *keys,
            *([] if single else ["q"]),
            F.when(F.coalesce(F.col("hit.total"), F.lit(0.0)) == 0, F.lit(None).cast("double"))
            .when(F.col("hit.le") == float("inf"), F.col("top"))
            .otherwise(F.col("hit.floor") + (F.col("hit.le") - F.col("hit.floor")) * inside)
            .alias("value"),
        )
    )


def vector_ratio(numerator: DataFrame, denominator: DataFrame) -> DataFrame:
    """Quotient of samples with equal labels (the name aside) and timestamp; null where divided by 0."""
    top = numerator.select("series", "timestamp", F.col("value").alias("top"))
    bottom = denominator.select("series", "timestamp", F.col("value").alias("bottom"))
    return top.join(bottom, ["series", "timestamp"]).select(
        "series", "timestamp", F.try_divide("top", "bottom").alias("value")
    )
