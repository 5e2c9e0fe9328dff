"""Alert rules, their evaluation on a tick grid, alert states, silences and the notification outbox.

Rules, silences and channels are configuration tables; they are broadcast after a check of their size
and joined like any table beyond it.  Evaluations and everything after them are plain DataFrame plans.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window, functions as F

from telemill.functions.fields import compare, service_series, sorted_labels
from telemill.functions.timegrid import MICROS, ceil_div, floor_div, long_lit, micros, prune_days, ts_lit
from telemill.operators import sliding
from telemill.operators.joins import SMALL_ROWS, small_side
from telemill.operators.metrics import Selector, tag_selected
from telemill.session import config_table

SEVERITIES = ("critical", "warning", "info")
DEFAULT_LOOKBACK_S = 300
DAY_US = 86_400 * MICROS

# -- rules --------------------------------------------------------------------------------------


def flatten_rules(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rule groups to (enabled rules, invalid rules with a reason)."""
    rules = groups.select(F.col("name").alias("group_name"), F.explode("rules").alias("rule")).select(
        "group_name", "rule.*"
    )
    reason = (
        F.when(F.coalesce("name", F.lit("")) == "", "name is required")
        .when(F.coalesce("expression", F.lit("")) == "", "expression is required")
        .when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "invalid severity")
    )
    checked = rules.withColumn("reason", reason)
    valid = checked.filter(F.col("reason").isNull() & F.col("enabled")).drop("reason")
    return valid, checked.filter(F.col("reason").isNotNull()).select("group_name", "name", "reason")


def load_rules(groups: DataFrame) -> DataFrame:
    """Enabled rules; raises ValueError if any rule of any group is invalid."""
    rules, invalid = flatten_rules(groups)
    bad = invalid.first()
    if bad is not None:
        raise ValueError(f"rule {bad['name']!r} in group {bad['group_name']!r}: {bad['reason']}")
    return rules


def fingerprint(name: Column, labels: Column) -> Column:
    """First 16 hex digits of SHA-256 over the rule name and its ``k=v,`` pairs in key order."""
    pairs = F.transform(
        F.sort_array(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(","))
    )
    return F.substring(F.sha2(F.concat(name, F.coalesce(F.array_join(pairs, ""), F.lit(""))), 256), 1, 16)


def lookback_s() -> Column:
    """Seconds a rule looks back: its duration, or five minutes without one."""
    return F.when(F.col("duration_s") > 0, F.col("duration_s")).otherwise(F.lit(DEFAULT_LOOKBACK_S)).cast("bigint")


# -- evaluation ---------------------------------------------------------------------------------


def longest_lookback_s(rules: DataFrame) -> int:
    """Seconds that the rule with the longest lookback looks back; 0 without rules."""
    return rules.agg(F.max(lookback_s())).first()[0] or 0


def rule_points(points: DataFrame, selectors: Mapping[str, Selector], start, end, rules: DataFrame | None = None) -> DataFrame:
    """Points each rule looks at, tagged with ``rule_name``, in one scan for all rules.

    With ``rules``, ``start`` and ``end`` are the range of ticks, and points are read from the longest lookback before it.
    Without, they are the range of points.
    """
    if rules is not None:
        start = micros(start) - longest_lookback_s(rules) * MICROS
    return (
        prune_days(points, "timestamp", start, end)
        .transform(tag_selected, selectors, "rule_name")
        .select("rule_name", service_series().alias("series"), "timestamp", "value")
    )


def linked_samples(points: DataFrame, rules: DataFrame, keys: Sequence[str], start, end, interval_s: int) -> DataFrame:
    """The points that ticks see, with their neighbours in time, running totals and the rule's ``range_us``."""
    looks = small_side(rules.select(F.col("name").alias("rule_name"), (lookback_s() * long_lit(MICROS)).alias("range_us")))
    seen = points.join(looks, "rule_name").withColumn("at", F.unix_micros("timestamp"))
    seen = sliding.visible(seen, interval_s * MICROS, micros(start), micros(end))
    return sliding.linked(seen, keys).join(looks, "rule_name")


def samples_by_tick(points: DataFrame, rules: DataFrame, start, end, interval_s: int) -> DataFrame:
    """What every (rule, series) sees at every tick: first value, last value, number of samples.

    Latest and first are by time, then value.  Rows grow with ticks that see data, not with lookback / interval.
    """
    keys = ["rule_name", "series"]
    samples = linked_samples(points, rules, keys, start, end, interval_s)
    ticks = sliding.at_ticks(samples, keys, interval_s * MICROS, micros(start), micros(end))
    return ticks.select(*keys, "tick_us", "first_value", "last_value", "n")


def absences(points: DataFrame, rules: DataFrame, start, end, interval_s: int, per_series: bool = False) -> DataFrame:
    """Runs of ticks without data: rule_name, series if asked for, from_us, to_us (first and last tick of the run).

    By default a run is without data of any series of the rule.  A rule that never sees a point has one run over all
    ticks; its ``series`` is empty.  Rows are bounded by the points, whatever the number of ticks.
    """
    step_us = interval_s * MICROS
    first, last = micros(start), micros(end)
    keys = ["rule_name", "series"] if per_series else ["rule_name"]
    samples = linked_samples(points, rules, keys, start, end, interval_s)
    runs = sliding.gaps(samples, keys, step_us, first, last)
    low, high = -(-first // step_us) * step_us, last // step_us * step_us
    if low > high:
        return runs
    seen = samples.select(F.col("rule_name").alias("_seen")).distinct()
    silent = rules.select(F.col("name").alias("rule_name")).join(seen, F.col("rule_name") == F.col("_seen"), "left_anti")
    silent = silent.withColumn("from_us", long_lit(low)).withColumn("to_us", long_lit(high))
    if per_series:
        silent = silent.withColumn("series", sorted_labels(F.create_map().cast("map<string,string>")))
    return runs.unionByName(silent.select(runs.columns))


def rate_of_change(first: Column, last: Column, n: Column) -> Column:
    """Relative change over the lookback; 0 with fewer than two samples or a first value of 0."""
    return F.when((n >= 2) & (first != 0), F.try_divide(last - first, first)).otherwise(F.lit(0.0))


def _span_text(seconds: Column) -> Column:
    """Seconds as hours, minutes and seconds, leading zero units left out: 1h0m0s, 5m0s, 30s."""
    h = F.call_function("div", seconds, F.lit(3600)).cast("string")
    m = F.call_function("div", seconds % 3600, F.lit(60)).cast("string")
    s = (seconds % 60).cast("string")
    return (
        F.when(seconds >= 3600, F.concat(h, F.lit("h"), m, F.lit("m"), s, F.lit("s")))
        .when(seconds >= 60, F.concat(m, F.lit("m"), s, F.lit("s")))
        .otherwise(F.concat(s, F.lit("s")))
    )


def evaluate_rules(
    points: DataFrame, rules: DataFrame, start, end, interval_s: int, per_series: bool = False
) -> DataFrame:
    """One row per rule and tick: does it fire, with which value and message.

    By default a rule looks at its first series by label key; with ``per_series`` every series is
    evaluated on its own and adds its labels to those of the rule.  Without data a rule fires only
    through an absence condition, with value 0.  With data the first condition that holds gives the
    message; a rule without conditions fires on a positive value.
    """
    step_us = interval_s * MICROS
    first_tick, last_tick = -(-micros(start) // step_us), micros(end) // step_us
    seen = samples_by_tick(points, rules, start, end, interval_s)
    subjects = rules.withColumnRenamed("name", "rule_name")
    if per_series:
        # Ticks with data, and the runs of ticks without, written out.
        runs = absences(points, rules, start, end, interval_s, per_series=True)
        ticks = F.explode(F.sequence("from_us", "to_us", long_lit(step_us)))
        nothing = [F.lit(None).cast(seen.schema[c].dataType).alias(c) for c in ("first_value", "last_value", "n")]
        empty = runs.select("rule_name", "series", ticks.alias("tick_us"), *nothing)
        joined = seen.unionByName(empty).join(small_side(subjects), "rule_name")
    else:
        seen = (
            seen.groupBy("rule_name", "tick_us")
            .agg(F.min(F.struct("series", "first_value", "last_value", "n")).alias("s"))
            .select("rule_name", "tick_us", "s.first_value", "s.last_value", "s.n")
        )
        ticks = F.transform(F.sequence(long_lit(first_tick), long_lit(last_tick)), lambda k: k * long_lit(step_us))
        joined = subjects.withColumn("tick_us", F.explode(ticks)).join(seen, ["rule_name", "tick_us"], "left")

    present = F.col("n").isNotNull()
    change = rate_of_change(F.col("first_value"), F.col("last_value"), F.col("n"))

    def holds(c: Column) -> Column:
        return (
            F.when(c["type"] == "threshold", compare(F.col("last_value"), c["operator"], c["threshold"]))
            .when(c["type"] == "rate_of_change", compare(F.abs("change"), c["operator"], c["threshold"]))
            .otherwise(F.lit(False))
        )

    conditions = F.coalesce("conditions", F.array().cast("array<struct<type: string, operator: string, threshold: double>>"))
    evaluated = (
        joined.withColumn("change", change)
        .withColumn("conditions", conditions)
        .withColumn("hit", F.try_element_at(F.filter("conditions", holds), F.lit(1)))
        .withColumn("absent", ~present & F.exists("conditions", lambda c: c["type"] == "absence"))
    )
    fallback = present & (F.size("conditions") == 0) & (F.col("last_value") > 0)
    # The wording and the number formats of messages.
    message = (
        F.when(F.col("absent"), F.concat(F.lit("no data for "), _span_text(lookback_s())))
        .when(
            F.col("hit.type") == "threshold",
            F.format_string("value %.4f %s threshold %.4f", "last_value", "hit.operator", "hit.threshold"),
        )
        .when(
            F.col("hit.type") == "rate_of_change",
            F.format_string("rate of change %.4f %s threshold %.4f", "change", "hit.operator", "hit.threshold"),
        )
        .otherwise(F.lit(""))
    )
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    if per_series:
        own = F.col("series")
        labels = F.map_from_entries(
            F.concat(F.filter(sorted_labels(labels), lambda e: ~F.exists(own, lambda o: o["key"] == e["key"])), own)
        )
    return evaluated.select(
        "rule_name",
        labels.alias("labels"),
        F.coalesce(F.col("duration_s"), F.lit(0)).cast("bigint").alias("duration_s"),
        "severity",
        "annotations",
        "notification_channels",
        "tick_us",
        (F.col("absent") | (present & F.col("hit").isNotNull()) | fallback).alias("firing"),
        F.coalesce("last_value", F.lit(0.0)).alias("value"),
        F.when(present | F.col("absent"), message).otherwise(F.lit("")).alias("message"),
    ).withColumn("fingerprint", fingerprint(F.col("rule_name"), F.col("labels")))


# -- states -------------------------------------------------------------------------------------


def alert_states(evaluations: DataFrame) -> DataFrame:
    """State of every alert after every tick that left it in one, or resolved it.

    A run of firing ticks is ``pending`` until, from its second tick on, it has lasted the rule's
    duration; then it is ``firing``.  The first tick not firing after a run is ``resolved``, also when
    the run never got past pending.  ``starts_us`` is the first tick of the run, ``entered`` marks the
    ticks on which the state changed.  Rows of failed evaluations must be left out by the caller; they
    change nothing.

    The windows run over one alert's ticks: their number is set by the evaluated range and interval,
    not by how many points the alert's series have.
    """
    by_tick = Window.partitionBy("fingerprint").orderBy("tick_us")
    upto = by_tick.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_run = Window.partitionBy("fingerprint", "run").orderBy("tick_us")
    run_upto = in_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # A run is numbered by the quiet ticks before it; a quiet tick opens the next number itself.
    numbered = evaluations.withColumn("quiet", F.sum(F.when(F.col("firing"), 0).otherwise(1)).over(upto)).withColumn(
        "run", F.when(F.col("firing"), F.col("quiet")).otherwise(F.col("quiet") - 1)
    )
    # Inside a run number: its firing ticks, then the quiet tick that ends it.
    placed = (
        numbered.withColumn("nth", F.row_number().over(in_run))
        .withColumn("starts_us", F.min("tick_us").over(run_upto))
        .filter(F.col("firing") | (F.col("nth") > 1))
    )
    old_enough = (F.col("nth") >= 2) & (F.col("tick_us") - F.col("starts_us") >= F.col("duration_s") * long_lit(MICROS))
    state = F.when(~F.col("firing"), "resolved").when(old_enough, "firing").otherwise("pending")
    stated = placed.withColumn("state", state)
    before = F.lag("state").over(in_run)
    return (
        stated.withColumn("entered", before.isNull() | (before != F.col("state")))
        .withColumn("ends_us", F.when(F.col("state") == "resolved", F.col("tick_us")))
        .drop("quiet", "run", "nth")
    )


def alert_transitions(states: DataFrame) -> DataFrame:
    """Ticks on which an alert became pending, firing or resolved."""
    return states.filter("entered").drop("entered")


def active_alerts(states: DataFrame, at=None) -> DataFrame:
    """Alerts whose latest state (up to ``at``) is firing."""
    if at is not None:
        states = states.filter(F.col("tick_us") <= micros(at))
    latest = states.groupBy("fingerprint").agg(F.max_by(F.struct(*states.columns), "tick_us").alias("s"))
    return latest.select("s.*").filter(F.col("state") == "firing")


# -- silences -----------------------------------------------------------------------------------


def valid_silence() -> Column:
    return (
        (F.coalesce(F.size("matchers"), F.lit(0)) > 0)
        & F.col("starts_at").isNotNull()
        & F.coalesce(F.col("ends_at") > F.col("starts_at"), F.lit(False))
        & (F.coalesce("created_by", F.lit("")) != "")
    )


def bad_patterns(changes: DataFrame) -> list[str]:
    """Patterns of a silence table that do not compile.  Silences are configuration: distinct patterns are looked at."""
    spark = changes.sparkSession
    patterns = changes.select(F.explode("matchers").alias("m")).filter("m.is_regex AND m.value IS NOT NULL").select("m.value")
    bad = []
    for (pattern,) in patterns.distinct().toLocalIterator():
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except (Py4JJavaError, IllegalArgumentException):
            bad.append(pattern)
    return sorted(bad)


def _has_bad_pattern(bad: Sequence[str]) -> Column:
    return F.coalesce(F.exists("matchers", lambda m: m["is_regex"] & m["value"].isin(*bad)), F.lit(False)) if bad else F.lit(False)


def invalid_silences(changes: DataFrame) -> DataFrame:
    """Changes that :func:`current_silences` leaves out as invalid: id, updated_at and the first reason."""
    reason = (
        F.when(F.coalesce(F.size("matchers"), F.lit(0)) <= 0, "no matchers")
        .when(F.col("starts_at").isNull(), "no start")
        .when(~F.coalesce(F.col("ends_at") > F.col("starts_at"), F.lit(False)), "end is not after start")
        .when(F.coalesce("created_by", F.lit("")) == "", "no creator")
        .when(_has_bad_pattern(bad_patterns(changes)), "bad pattern")
    )
    checked = changes.select("id", "updated_at", reason.alias("reason"))
    return checked.filter(F.col("reason").isNotNull())


def current_silences(changes: DataFrame) -> DataFrame:
    """Latest version of every silence, deleted and invalid ones left out, those with a bad pattern among them.

    Of versions with the same time a deletion counts first, then the greatest in the order of the columns.
    """
    others = [c for c in changes.columns if c not in ("id", "updated_at", "deleted")]
    version = F.struct("updated_at", F.coalesce("deleted", F.lit(False)).alias("deleted"), *others)
    latest = changes.groupBy("id").agg(F.max(version).alias("s")).select("id", "s.*").select(*changes.columns)
    return latest.filter(~F.coalesce("deleted", F.lit(False)) & valid_silence() & ~_has_bad_pattern(bad_patterns(changes)))


def active_silences(silences: DataFrame, at) -> DataFrame:
    """Silences in effect at an instant: start included, end excluded."""
    now = ts_lit(at)
    return silences.filter((F.col("starts_at") <= now) & (now < F.col("ends_at")))


def matched_by(matchers: Column, labels: Column) -> Column:
    """All matchers hold.  A label that is missing matches nothing; patterns match anywhere in the value."""

    def one(m: Column) -> Column:
        value = labels[m["name"]]
        equal = F.when(m["is_regex"], F.rlike(value, m["value"])).otherwise(value == m["value"])
        return F.coalesce(equal == m["is_equal"], F.lit(False))

    return F.forall(matchers, one)


#: Days of a cell are powers of this; so many levels reach beyond the year 9999 from the year 1.
CELL_BASE, CELL_LEVELS = 4, 12


def silence_cells(silences: DataFrame) -> DataFrame:
    """Each silence as cells of days: level, cell (of ``CELL_BASE ** level`` days), s_from, s_to, matchers.

    The days a silence touches are cut into the largest aligned cells, as in a digital clock: at most six of a level, of
    which the outermost hold days at the ends and the next level takes over in the middle.  A silence of a year has
    about twenty cells and one of ten thousand years about fifty, where a row per day would be millions.
    """
    first = floor_div(F.unix_micros("starts_at"), DAY_US)
    end = floor_div(F.unix_micros("ends_at") - 1, DAY_US) + 1  # the day after the last one
    levels = []
    for level in range(CELL_LEVELS):
        size = CELL_BASE**level
        lo, hi = ceil_div(first, size), floor_div(end, size)
        upper_lo, upper_hi = ceil_div(first, size * CELL_BASE) * CELL_BASE, floor_div(end, size * CELL_BASE) * CELL_BASE
        whole = upper_lo >= upper_hi if level < CELL_LEVELS - 1 else F.lit(True)  # nothing for the next level

        def cells(begin: Column, stop: Column, level: int = level) -> Column:
            nothing = F.array().cast("array<struct<level: int, cell: bigint>>")
            found = F.transform(F.sequence(begin, stop - 1), lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))
            return F.when(begin < stop, found).otherwise(nothing)

        levels.append(F.when(whole, cells(lo, hi)).otherwise(F.concat(cells(lo, upper_lo), cells(upper_hi, hi))))
    return silences.select(
        F.explode(F.concat(*levels)).alias("_c"),
        F.unix_micros("starts_at").alias("s_from"),
        F.unix_micros("ends_at").alias("s_to"),
        "matchers",
    ).select("_c.level", "_c.cell", "s_from", "s_to", "matchers")


def unsilenced(transitions: DataFrame, silences: DataFrame, start=None, end=None) -> DataFrame:
    """Transitions not covered by a silence in effect at their tick.

    A silence lies in a few cells of days of different sizes (:func:`silence_cells`), so the match is, for each size in
    use, an equality on the cell with the exact times and matchers as further conditions: a hash join per size, never
    every transition against every silence.  Given the range of the ticks, other silences are left out before.
    """
    if start is not None:
        silences = silences.filter(F.col("ends_at") > ts_lit(start))
    if end is not None:
        silences = silences.filter(F.col("starts_at") <= ts_lit(end))
    cells = silence_cells(silences.filter(F.col("starts_at") < F.col("ends_at")))
    found = cells.limit(SMALL_ROWS + 1).collect()
    if len(found) <= SMALL_ROWS:  # configuration as a rule: known by now, and joined as literal rows
        of_level: dict[int, list[tuple]] = {}
        for row in found:
            of_level.setdefault(row["level"], []).append(tuple(row)[1:])
        schema = cells.drop("level").schema
        owns = {level: F.broadcast(config_table(cells.sparkSession, rows, schema)) for level, rows in of_level.items()}
    else:
        levels = [level for (level,) in cells.select("level").distinct().collect()]  # at most CELL_LEVELS numbers
        owns = {level: cells.filter(F.col("level") == level).drop("level") for level in levels}
    left = transitions
    for level, own in sorted(owns.items()):
        day = floor_div(F.col("tick_us"), DAY_US * CELL_BASE**level)
        left = left.withColumn("_cell", day).join(
            own,
            (F.col("_cell") == F.col("cell"))
            & (F.col("s_from") <= F.col("tick_us"))
            & (F.col("tick_us") < F.col("s_to"))
            & matched_by(F.col("matchers"), F.col("labels")),
            "left_anti",
        ).drop("_cell")
    return left


# -- notifications ------------------------------------------------------------------------------


def route(transitions: DataFrame, channels: DataFrame) -> DataFrame:
    """A candidate notification per transition to firing or resolved and known channel of the rule."""
    return (
        transitions.filter(F.col("state").isin("firing", "resolved"))
        .withColumn("channel", F.explode(F.array_distinct("notification_channels")))
        .join(small_side(channels), "channel")
    )


def suppress_repeats(candidates: DataFrame) -> DataFrame:
    """Drop a notification if the last one *sent* for its (alert, channel, status) is too recent.

    What was sent depends on what was sent before: a chain that no window frame expresses.  The rows of a key are sorted
    in one task and pass by once, in batches, with the last instant sent as the only state; they come out as they are,
    so there is nothing to join back, and a key's number of rows takes time but no memory.
    """
    keys = ["fingerprint", "channel", "state"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, 0
        for batch in batches:
            ticks, repeats = (batch.column(c).to_pylist() for c in ("tick_us", "repeat_interval_s"))
            sent = []
            for key, tick, repeat in zip(zip(*(batch.column(c).to_pylist() for c in keys)), ticks, repeats):
                due = key != before or tick - last >= repeat * MICROS
                if due:
                    before, last = key, tick
                sent.append(due)
            yield batch.filter(pa.array(sent, pa.bool_()))

    ordered = candidates.repartition(*keys).sortWithinPartitions(*keys, "tick_us")
    return ordered.mapInArrow(send, candidates.schema)


def notifications(candidates: DataFrame) -> DataFrame:
    """Outbox rows, one alert each; delivery is left to whoever reads the outbox."""
    return candidates.select(
        F.col("fingerprint").alias("group_key"),
        F.col("state").alias("status"),
        F.col("channel").alias("receiver"),
        F.col("labels").alias("group_labels"),
        F.array(
            F.struct("rule_name", "severity", "labels", "annotations", "value", "starts_us", "ends_us", "fingerprint")
        ).alias("alerts"),
        # Fixed value: the wording of titles.
        F.format_string("[%s] %d alert(s)", F.upper("state"), F.lit(1)).alias("title"),
        F.timestamp_micros("tick_us").alias("sent_at"),
    )


def outbox(states: DataFrame, silences: DataFrame, channels: DataFrame) -> DataFrame:
    """From alert states to the notifications that go out."""
    candidates = route(unsilenced(alert_transitions(states), silences), channels)
    return notifications(suppress_repeats(candidates))
