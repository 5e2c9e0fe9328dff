"""Rules, evaluation, states, silences, notifications."""

import hashlib
import random

import pytest
from conftest import T0, at, point, points, rows
from pyspark.sql import functions as F

from telemill.functions import fields
from telemill.functions.timegrid import MICROS, micros
from telemill.operators import alerts as ops
from telemill.operators.metrics import Selector
from telemill.schemas import CHANNEL_SCHEMA, RULE_GROUP_SCHEMA, SILENCE_SCHEMA


def rule(name="r", expression="x", duration=0, severity="critical", enabled=True, labels=None, conditions=(), channels=()):
    return (name, expression, duration, severity, enabled, labels or {}, {"summary": name}, list(conditions), list(channels))


def rules(spark, *rows):
    return ops.load_rules(spark.createDataFrame([("g", list(rows))], RULE_GROUP_SCHEMA))


@pytest.mark.parametrize(
    "value, operator, threshold, expected",
    [(0.1, ">", 0.05, True), (0.01, ">", 0.05, False), (0.05, ">=", 0.05, True), (1.0, "<", 2.0, True),
     (2.0, "<=", 2.0, True), (1.0, "!=", 0.0, True), (1.0, "!=", 1.0, False), (1.0, "==", 1.0, True),
     (1.0, "=", 1.0, True), (1.0, "~", 1.0, False)],
)
def test_threshold_operators(spark, value, operator, threshold, expected):
    df = spark.createDataFrame([(value, operator, threshold)], "v double, o string, t double")
    assert rows(df, fields.compare(F.col("v"), F.col("o"), F.col("t"))) == [(expected,)]


def test_rule_validation(spark):
    got = rules(spark, rule("test_rule", duration=300), rule("latency_rule", severity="warning"), rule("off", enabled=False))
    assert sorted(rows(got, "name")) == [("latency_rule",), ("test_rule",)]
    for bad in (rule(name=""), rule(expression=""), rule(severity="loud"), rule(severity="loud", enabled=False)):
        with pytest.raises(ValueError):
            rules(spark, rule("fine"), bad)


def test_fingerprint(spark):
    df = spark.createDataFrame([("rule", {"team": "a", "env": "b"}), ("rule", {})], "n string, l map<string,string>")
    want = [hashlib.sha256(t.encode()).hexdigest()[:16] for t in ("ruleenv=b,team=a,", "rule")]
    assert [r[0] for r in rows(df, ops.fingerprint(F.col("n"), F.col("l")))] == want


def evaluate(spark, data, *rule_rows, start=0, end=600, interval=60, per_series=False):
    df = points(spark, *data)
    selectors = {r[0]: Selector("m") for r in rule_rows}
    tagged = ops.rule_points(df, selectors, at(-86400), at(end))
    return ops.evaluate_rules(tagged, rules(spark, *rule_rows), at(start), at(end), interval, per_series)


def by_tick(df):
    return {(r["rule_name"], r["tick_us"] // MICROS - int(T0.timestamp())): (r["firing"], r["value"], r["message"]) for r in df.collect()}


def test_evaluation(spark):
    data = [point("m", 5, 0), point("m", 20, 50), point("m", 0, 130)]
    got = by_tick(
        evaluate(
            spark, data,
            rule("threshold", duration=60, conditions=[("threshold", ">", 10.0)]),
            rule("change", duration=60, conditions=[("rate_of_change", ">", 2.5)]),
            rule("gone", duration=60, conditions=[("absence", "", 0.0)]),
            rule("plain", duration=60),
            rule("two", duration=60, conditions=[("threshold", "<", 50.0), ("threshold", ">", 1.0)]),
            end=300,
        )
    )
    assert got["threshold", 0] == (False, 5.0, "")
    assert got["threshold", 60] == (True, 20.0, "value 20.0000 > threshold 10.0000")
    assert got["threshold", 120] == (False, 0.0, "")  # the sample at 50 is out of sight: no data
    assert got["change", 0] == (False, 5.0, "")  # one sample
    assert got["change", 60] == (True, 20.0, "rate of change 3.0000 > threshold 2.5000")
    assert got["gone", 120] == (True, 0.0, "no data for 1m0s") and not got["gone", 60][0]
    assert got["plain", 60][0] and not got["plain", 120][0] and not got["plain", 180][0]
    assert got["two", 60] == (True, 20.0, "value 20.0000 < threshold 50.0000")
    assert len(got) == 5 * 6


def test_lookback_includes_both_ends_and_first_zero(spark):
    data = [point("m", 0, 0), point("m", 9, 60)]
    got = by_tick(evaluate(spark, data, rule("c", duration=60, conditions=[("rate_of_change", ">", 0.0)]), end=120))
    assert got["c", 60] == (False, 9.0, "")  # change from 0 counts as 0
    data = [point("m", 3, 0), point("m", 9, 60)]
    got = by_tick(evaluate(spark, data, rule("c", duration=60, conditions=[("rate_of_change", ">", 1.9)]), end=120))
    assert got["c", 60][0] and not got["c", 120][0]


def test_default_lookback_and_first_series(spark):
    data = [point("m", 1, 0, a="2"), point("m", 7, 10, a="1"), point("m", 3, 200, a="2")]
    got = by_tick(evaluate(spark, data, rule("r", conditions=[("threshold", ">", 0.0)]), end=600))
    assert [got["r", t][1] for t in (0, 60, 240, 300, 360, 480, 540)] == [1.0, 7.0, 7.0, 7.0, 3.0, 3.0, 0.0]


def test_per_series(spark):
    data = [point("m", 1, 0, a="1"), point("m", 20, 0, a="2")]
    out = evaluate(
        spark, data, rule("r", labels={"team": "x", "a": "rule"}, conditions=[("threshold", ">", 10.0)]),
        rule("none", conditions=[("absence", "", 0.0)]), end=0, per_series=True,
    )
    got = {(r["rule_name"], r["labels"].get("a")): (r["firing"], r["fingerprint"]) for r in out.collect()}
    assert got["r", "1"][0] is False and got["r", "2"][0] is True
    assert len({f for _, f in got.values()}) == len(got)


def simulate(ticks, duration):
    """Sequential state machine; (tick, state, starts) per tick with a state."""
    state, starts, out = None, None, []
    for tick, firing in ticks:
        if firing:
            if state is None:
                state, starts = "pending", tick
            elif state == "pending" and tick - starts >= duration:
                state = "firing"
            out.append((tick, state, starts))
        elif state:
            out.append((tick, "resolved", starts))
            state = None
    return out


def evaluations(spark, runs):
    """runs: {fingerprint: (duration, [(tick seconds, firing)])}"""
    data = [
        (fp, fp, {"team": fp[:1], "env": "prod"}, duration, "critical", {}, ["chat", "pager", "nowhere"], tick * MICROS, firing, float(tick), "")
        for fp, (duration, ticks) in runs.items()
        for tick, firing in ticks
    ]
    schema = (
        "fingerprint string, rule_name string, labels map<string,string>, duration_s bigint, severity string, "
        "annotations map<string,string>, notification_channels array<string>, tick_us bigint, firing boolean, value double, message string"
    )
    return spark.createDataFrame(data, schema)


def random_runs(seed, n=12, ticks=80):
    rng = random.Random(seed)
    return {
        f"{'abc'[i % 3]}{i}": (
            rng.choice([0, 30, 90, 300]),
            [(t * 30, rng.random() < 0.75) for t in range(ticks) if rng.random() < 0.9],
        )
        for i in range(n)
    }


def test_states_against_simulation(spark):
    runs = random_runs(3)
    states = ops.alert_states(evaluations(spark, runs))
    got = sorted(rows(states, "fingerprint", "tick_us", "state", "starts_us"))
    want = sorted((fp, t * MICROS, s, b * MICROS) for fp, (d, ticks) in runs.items() for t, s, b in simulate(ticks, d))
    assert got == want
    entered = sorted(rows(ops.alert_transitions(states), "fingerprint", "tick_us", "state"))
    assert len(entered) < len(got)
    for fp, (d, ticks) in runs.items():
        last = None
        mine = [(t, s) for f, t, s in entered if f == fp]
        for tick, state, _ in simulate(ticks, d):
            if state != last:
                assert mine.pop(0) == (tick * MICROS, state)
            last = None if state == "resolved" else state
        assert not mine


def test_state_details(spark):
    runs = {
        "zero": (0, [(0, True), (30, True), (60, False)]),  # duration 0: firing on the second tick
        "five": (300, [(0, True), (360, True), (390, False)]),
        "short": (300, [(0, True), (30, False), (60, False)]),  # resolved from pending
        "on": (0, [(0, True), (30, True)]),
    }
    states = ops.alert_states(evaluations(spark, runs))
    seen = {}
    for fp, state, tick in rows(ops.alert_transitions(states).orderBy("tick_us"), "fingerprint", "state", "tick_us"):
        seen.setdefault(fp, []).append((state, tick // MICROS))
    assert seen["zero"] == [("pending", 0), ("firing", 30), ("resolved", 60)]
    assert seen["five"] == [("pending", 0), ("firing", 360), ("resolved", 390)]
    assert seen["short"] == [("pending", 0), ("resolved", 30)]
    assert rows(ops.active_alerts(states), "fingerprint") == [("on",)]
    assert sorted(rows(ops.active_alerts(states, 30 * MICROS), "fingerprint")) == [("on",), ("zero",)]


def silence(id="s", matchers=(("team", "a", False, True),), start=-3600, end=3600, by="ann", updated=0, deleted=False):
    return (id, list(matchers), at(start), at(end), by, "", at(updated), deleted)


def silences(spark, *rows):
    return spark.createDataFrame(list(rows), SILENCE_SCHEMA)


def test_silence_window(spark):
    df = silences(spark, silence("now"), silence("past", start=-7200, end=-3600), silence("next", start=3600, end=7200), silence("edge", start=0, end=1))
    assert sorted(rows(ops.active_silences(df, at(0)), "id")) == [("edge",), ("now",)]
    assert sorted(rows(ops.active_silences(df, at(1)), "id")) == [("now",)]


@pytest.mark.parametrize(
    "matchers, expected",
    [
        ([("team", "a", False, True)], True),
        ([("team", "b", False, True)], False),
        ([("team", "b", False, False)], True),
        ([("team", "a", False, False)], False),
        ([("env", "ro", True, True)], True),
        ([("env", "^ro", True, True)], False),
        ([("env", "^ro", True, False)], True),
        ([("env", "ro", True, False)], False),
        ([("zone", "x", False, False)], False),
        ([("zone", ".*", True, True)], False),
        ([("team", "a", False, True), ("env", "test", False, True)], False),
        ([("team", "a", False, True), ("env", "prod", False, True)], True),
    ],
)
def test_silence_matchers(spark, matchers, expected):
    t = micros(at(0))
    moved = spark.createDataFrame([({"team": "a", "env": "prod"}, t)], "labels map<string,string>, tick_us bigint")
    assert (ops.unsilenced(moved, silences(spark, silence(matchers=matchers))).count() == 0) == expected


def test_silences_over_days(spark):
    ticks = [micros(at(h * 3600)) for h in range(-40, 60)]
    moved = spark.createDataFrame([({"team": "a"}, t) for t in ticks], "labels map<string,string>, tick_us bigint")
    left = ops.unsilenced(moved, silences(spark, silence(start=-30 * 3600, end=50 * 3600), silence(matchers=[("team", "z", False, True)])))
    assert sorted(r[0] for r in rows(left, "tick_us")) == [t for t in ticks if not ticks[10] <= t < ticks[90]]


def test_silence_changes(spark):
    changes = silences(
        spark, silence("a", end=10), silence("a", end=20, updated=1), silence("b"), silence("b", updated=1, deleted=True),
        silence("no-matchers", matchers=()), silence("no-creator", by=""), silence("backwards", start=5, end=5),
    )
    got = ops.current_silences(changes)
    assert rows(got, "id", "updated_at") == [("a", at(1).replace(tzinfo=None))]


def test_repeat_suppression_against_simulation(spark):
    rng = random.Random(9)
    data, want = [], []
    for key in range(8):
        interval, last = rng.choice([0, 60, 3600]), None
        for t in sorted(rng.sample(range(0, 40000, 10), 60)):
            data.append((f"f{key}", "c", "firing", t * MICROS, interval))
            if last is None or t - last >= interval:  # what was suppressed does not count as sent
                want.append((f"f{key}", t * MICROS))
                last = t
    df = spark.createDataFrame(data, "fingerprint string, channel string, state string, tick_us bigint, repeat_interval_s bigint")
    assert sorted(rows(ops.suppress_repeats(df), "fingerprint", "tick_us")) == sorted(want)


def test_outbox(spark):
    runs = {"a1": (0, [(0, True), (30, True), (60, False)]), "b1": (0, [(0, True), (30, True), (60, False), (90, True), (120, True)])}
    states = ops.alert_states(evaluations(spark, runs))
    channels = spark.createDataFrame([("chat", 3600), ("pager", 10)], CHANNEL_SCHEMA)
    quiet = spark.createDataFrame(
        [("s", [("team", "a", False, True)], at(-10**10), at(10**8), "x", "", at(0), False)], SILENCE_SCHEMA
    )
    sent = ops.outbox(states, quiet, channels)
    got = sorted(rows(sent, "group_key", "receiver", "status", "title", F.unix_seconds("sent_at")))
    assert got == [
        ("b1", "chat", "firing", "[FIRING] 1 alert(s)", 30),  # the second one comes too soon
        ("b1", "chat", "resolved", "[RESOLVED] 1 alert(s)", 60),
        ("b1", "pager", "firing", "[FIRING] 1 alert(s)", 30),
        ("b1", "pager", "firing", "[FIRING] 1 alert(s)", 120),
        ("b1", "pager", "resolved", "[RESOLVED] 1 alert(s)", 60),
    ]
    alert = sent.first()["alerts"][0]
    assert alert["severity"] == "critical" and alert["labels"] == {"team": "b", "env": "prod"}


def test_invalid_silences_are_reported_and_ties_are_settled(spark):
    changes = silences(
        spark, silence("a"), silence("a", deleted=True), silence("b", matchers=()), silence("c", start=5, end=5),
        silence("d", by=""), silence("e"),
    )
    assert sorted(rows(ops.invalid_silences(changes), "id", "reason")) == [
        ("b", "no matchers"), ("c", "end is not after start"), ("d", "no creator"),
    ]
    assert rows(ops.current_silences(changes), "id") == [("e",)]


def test_a_long_silence_lies_in_few_cells(spark):
    """Every day of a silence lies in exactly one cell, whatever its length."""
    from datetime import datetime, timedelta, timezone

    rng = random.Random(2)
    day = lambda n: datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(days=n)
    ranges = [(0, 1), (5, 6), (3, 200), (-400, 700), (19723, 19724), (16, 64), (19000, 2_932_000)]
    ranges += [(a := rng.randrange(-5000, 30000), a + rng.randrange(1, 5000)) for _ in range(60)]
    rows_ = [(str(i), [("team", "a", False, True)], day(a), day(b), "x", "", at(0), False) for i, (a, b) in enumerate(ranges)]
    cells = ops.silence_cells(spark.createDataFrame(rows_, SILENCE_SCHEMA)).groupBy("s_from", "s_to").agg(F.collect_list(F.struct("level", "cell")).alias("c"))
    for r in cells.collect():
        assert len(r["c"]) < 100
        covered = sorted((c["cell"] * ops.CELL_BASE ** c["level"], (c["cell"] + 1) * ops.CELL_BASE ** c["level"]) for c in r["c"])
        assert covered[0][0] == r["s_from"] // ops.DAY_US and covered[-1][1] == r["s_to"] // ops.DAY_US
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_silences_of_any_length_against_brute_force(spark):
    rng = random.Random(6)
    quiet = [(f"s{i}", [("team", rng.choice("abc"), False, True)], s := rng.randrange(-90 * 86400, 60 * 86400), s + rng.choice([60, 86400, 40 * 86400, 250 * 10**9])) for i in range(12)]
    frame = silences(spark, *[(i, m, at(s), at(e), "x", "", at(0), False) for i, m, s, e in quiet])
    ticks = [(rng.choice("abc"), rng.randrange(-100 * 86400, 100 * 86400)) for _ in range(400)]
    base = micros(at(0))
    moved = spark.createDataFrame([({"team": t}, base + s * MICROS) for t, s in ticks], "labels map<string,string>, tick_us bigint")
    want = sorted((t, s) for t, s in ticks if not any(m[0][1] == t and a <= s < b for _, m, a, b in quiet))
    for limits in ((None, None), (at(-101 * 86400), at(101 * 86400))):
        got = sorted((r["labels"]["team"], (r["tick_us"] - base) // MICROS) for r in ops.unsilenced(moved, frame, *limits).collect())
        assert got == want and 0 < len(want) < len(ticks)


def test_a_bad_pattern_is_a_reject(spark):
    changes = silences(spark, silence("good", matchers=(("team", "^a(b|$)", True, True),)), silence("bad", matchers=(("team", "a(", True, True),)), silence("plain", matchers=(("team", "a(", False, True),)))
    assert rows(ops.invalid_silences(changes), "id", "reason") == [("bad", "bad pattern")]
    current = ops.current_silences(changes)
    assert sorted(rows(current, "id")) == [("good",), ("plain",)]
    moved = spark.createDataFrame([({"team": "a"}, micros(at(0))), ({"team": "x"}, micros(at(0)))], "labels map<string,string>, tick_us bigint")
    assert [r["labels"]["team"] for r in ops.unsilenced(moved, current).collect()] == ["x"]


def test_a_million_instants_of_one_key(spark):
    """One key, one pass: 90 s apart, repeated no sooner than 100 s, so every second one goes out."""
    df = spark.range(1_000_000).selectExpr("'f' AS fingerprint", "'c' AS channel", "'firing' AS state", "id * 90000000 AS tick_us", "100L AS repeat_interval_s", "'payload' AS more")
    sent = ops.suppress_repeats(df)
    assert sent.agg(F.count("*"), F.min("tick_us"), F.max("tick_us"), F.sum(F.col("tick_us") % 180000000)).first()[:] == (500_000, 0, 999_998 * 90000000, 0)
    assert sent.columns == df.columns
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
