"""Sliding lookbacks by prefix sums against looking at every tick's samples."""

import math
import random
from bisect import bisect_left, bisect_right
from collections import defaultdict

import pytest
from conftest import T0, at, point, points
from pyspark.sql import functions as F

from telemill.functions.timegrid import MICROS
from telemill.operators import alerts, metrics, sliding
from telemill.operators.metrics import Selector
from test_alerts import rule, rules

BASE = int(T0.timestamp())


def test_rate_over_a_day_every_fifteen_seconds(spark):
    """5,760 ticks see each sample; each tick is written twice, not once per sample it sees."""
    rng = random.Random(4)
    data = [("hot" if i % 3 == 0 else str(i % 5), rng.randrange(2 * 86400), float(rng.randrange(100))) for i in range(900)]
    df = points(spark, *[point("c", v, t, s=s) for s, t, v in data])
    got = {}
    for r in metrics.rate(df, 86400, 15, at(0), at(2 * 86400)).collect():
        label = next(e["value"] for e in r["series"] if e["key"] == "s")
        got[label, int(r["timestamp"].timestamp()) - BASE] = r["value"]
    series = defaultdict(list)
    for s, t, v in data:
        series[s].append((t, v))
    want = {}
    for s, samples in series.items():
        samples.sort()
        times = [t for t, _ in samples]
        up = [0.0]
        for (_, a), (_, b) in zip(samples, samples[1:]):
            up.append(up[-1] + (b - a if b >= a else b))
        for tick in range(-BASE % 15, 2 * 86400 + 1, 15):
            i, j = bisect_left(times, tick - 86400), bisect_right(times, tick) - 1
            if j > i and times[j] > times[i]:
                want[s, tick] = (up[j] - up[i]) / (times[j] - times[i])
    assert got.keys() == want.keys() and len(want) > 60_000
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def plain(samples, range_s, step_s, first, last):
    """tick -> (first value, last value, growth, number) of sorted samples (second, value)."""
    out = {}
    for tick in range(-(-first // step_s) * step_s, last + 1, step_s):
        seen = [(t, v) for t, v in samples if tick - range_s <= t <= tick]
        if seen:
            up = sum(b[1] - a[1] if b[1] >= a[1] else b[1] for a, b in zip(seen, seen[1:]))
            out[tick] = (seen[0][1], seen[-1][1], up, len(seen))
    return out


@pytest.mark.parametrize("range_s, step_s, chunk_s", [(300, 60, 3600), (100, 60, 7), (20, 300, 50), (4000, 70, 64), (60, 60, 60)])
def test_ends_growth_and_number_of_what_a_tick_sees(spark, range_s, step_s, chunk_s):
    rng = random.Random(range_s + chunk_s)
    data = [("hot" if i % 3 == 0 else str(rng.randrange(4)), rng.randrange(-500, 3000), float(rng.randrange(9))) for i in range(300)]
    data += [("one", 700, 1.0), ("ties", 800, 3.0), ("ties", 800, 1.0), ("ties", 800, 1.0)]
    df = spark.createDataFrame([(k, t * MICROS, v, range_s * MICROS) for k, t, v in data], "k string, at long, value double, range_us long")
    linked = sliding.linked(sliding.visible(df, step_s * MICROS, 0, 2500 * MICROS), ["k"], chunk_s).withColumn("range_us", F.lit(range_s * MICROS).cast("bigint"))
    rows = sliding.at_ticks(linked, ["k"], step_s * MICROS, 0, 2500 * MICROS).collect()
    got = {(r["k"], r["tick_us"] // MICROS): (r["first_value"], r["last_value"], r["up"], r["n"]) for r in rows}
    assert len(got) == len(rows)
    series = defaultdict(list)
    for k, t, v in data:
        series[k].append((t, v))
    want = {(k, tick): v for k, samples in series.items() for tick, v in plain(sorted(samples), range_s, step_s, 0, 2500).items()}
    assert got == want
    runs = sliding.gaps(linked, ["k"], step_s * MICROS, 0, 2500 * MICROS).collect()
    bare = [(r["k"], t // MICROS) for r in runs for t in range(r["from_us"], r["to_us"] + 1, step_s * MICROS)]
    seen = {k for k, _ in got}
    assert sorted(bare) == sorted((k, t) for k in seen for t in range(0, 2501, step_s) if (k, t) not in want)
    assert len(runs) <= len(data) + len(seen)


def test_growth_that_is_no_number_spoils_only_the_ticks_that_see_it(spark):
    values = [1.0, 2.0, math.inf, 5.0, 6.0, math.nan, 7.0, 9.0]
    df = points(spark, *[point("c", v, 60 * i) for i, v in enumerate(values)])
    got = {int(r["timestamp"].timestamp()) - BASE: r["value"] for r in metrics.rate(df, 60, 60, at(0), at(420)).collect()}
    assert got[60] == pytest.approx(1 / 60) and got[240] == pytest.approx(1 / 60) and got[420] == pytest.approx(2 / 60)
    assert got[120] == math.inf and math.isnan(got[300])


def test_points_are_read_from_the_longest_lookback_on(spark):
    """The first tick sees as far back as its rule asks for, whatever range the caller names."""
    df = points(spark, point("m", 4, -7000), point("m", 9, -100))
    given = rules(spark, rule("far", duration=7200, conditions=[("rate_of_change", ">", 1.0)]), rule("near", duration=60))
    tagged = alerts.rule_points(df, {"far": Selector("m"), "near": Selector("m")}, at(0), at(60), given)
    got = {(r["rule_name"], r["tick_us"]): r for r in alerts.evaluate_rules(tagged, given, at(0), at(60), 60).collect()}
    assert got["far", BASE * MICROS]["firing"] and not got["near", BASE * MICROS]["firing"]
    assert alerts.longest_lookback_s(given) == 7200 and alerts.longest_lookback_s(given.filter("false")) == 0


def test_a_rule_that_sees_nothing_is_one_run(spark):
    df = points(spark, point("m", 1, 0, a="x"), point("m", 1, 86_000, a="x"))
    given = rules(spark, rule("seen", duration=60), rule("blind", duration=60))
    tagged = alerts.rule_points(df, {"seen": Selector("m"), "blind": Selector("none")}, at(0), at(86400), given)
    for per_series in (False, True):
        runs = alerts.absences(tagged, given, at(0), at(86400), 60, per_series)
        found = sorted((r["rule_name"], (r["from_us"] - BASE * MICROS) // MICROS, (r["to_us"] - BASE * MICROS) // MICROS) for r in runs.collect())
        assert found == [("blind", 0, 86400), ("seen", 120, 85980), ("seen", 86100, 86400)]
    assert alerts.absences(tagged, given, at(1), at(2), 60).count() == 0


def test_samples_are_shuffled_once(spark, tmp_path):
    """The chunks' totals come from the same shuffle, and are joined to samples that lie where the window put them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        columns = [(F.col("id") % 3).alias("k"), (F.col("id") * MICROS).alias("at"), F.sqrt("id").alias("value")]
        spark.range(1000).select(*columns).write.parquet(str(tmp_path / "samples"))
        linked = sliding.linked(spark.read.parquet(str(tmp_path / "samples")), ["k"])
        linked.collect()
        plan = linked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
