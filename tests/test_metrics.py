"""Metric selection, rollups and vector functions."""

import random
from collections import defaultdict

import pytest
from conftest import T0, at, point, points, rows
from pyspark.sql import functions as F

from telemill.operators import metrics as ops
from telemill.operators.metrics import Selector
from telemill.schemas import HISTOGRAM_SCHEMA
from telemill.session import prepare_session


def vector(df, *labels):
    """{(labels..., seconds after T0): value}"""
    out = {}
    for r in df.collect():
        by_key = {e["key"]: e["value"] for e in r["series"]}
        out[(*[by_key.get(k) for k in labels], (r["timestamp"] - T0.replace(tzinfo=None)).total_seconds())] = r["value"]
    return out


@pytest.mark.parametrize(
    "seconds, expected",
    [(60, "1m"), (1800, "1m"), (3600, "1m"), (3601, "5m"), (7200, "5m"), (21599, "5m"), (21600, "1h"), (43200, "1h"),
     (86399, "1h"), (86400, "1d"), (172800, "1d"), (604800, "1d")],
)
def test_resolution(seconds, expected):
    assert ops.select_resolution(seconds) == expected


def test_label_lookup_and_matchers(spark):
    df = points(spark, point("m", 42, method="GET", status="200"), point("m", 1, status="503"), point("m", 2))

    def values(*matchers):
        return sorted(v for (v,) in rows(ops.select_points(df, Selector("m", matchers), at(0), at(0)), "value"))

    assert values(("method", "=", "GET")) == [42]
    assert values(("method", "=", "")) == [1, 2]
    assert values(("method", "!=", "GET")) == [1, 2]
    assert values(("status", "=~", "5..")) == [1]
    assert values(("status", "=~", "5.")) == []
    assert values(("status", "=~", "2|5..")) == [1]
    assert values(("status", "!~", "5..")) == [2, 42]
    assert values(("status", "=~", "50|503")) == [1]
    assert values(("status", "=~", ".*"), ("method", "!=", "")) == [42]
    with pytest.raises(ValueError):
        values(("status", "~", "x"))


def test_patterns_match_the_whole_value_including_a_final_newline(spark):
    df = points(spark, point("m", 1, s="ok\n"), point("m", 2, s="ok"))
    assert rows(ops.select_points(df, Selector("m", [("s", "=~", "ok")]), at(0), at(0)), "value") == [(2.0,)]


def test_select_points_order_service_limit(spark):
    df = points(spark, point("m", 3, 3), point("m", 1, 1), point("m", 2, 2, service="o"), point("n", 9, 1), point("m", 4, 9))
    assert rows(ops.select_points(df, Selector("m"), at(0), at(3)), "value") == [(1,), (2,), (3,)]
    assert rows(ops.select_points(df, Selector("m", service="o"), at(0), at(3)), "value") == [(2,)]
    assert rows(ops.select_points(df, Selector("m"), at(0), at(3), limit=2), "value") == [(1,), (2,)]


def test_rollups_merge_without_loss(spark):
    rng = random.Random(1)
    df = points(spark, *[point("m", rng.random(), rng.randrange(3 * 86400), a=str(i % 2)) for i in range(400)])
    for size in ("1h", "1d"):
        merged = ops.read_rollup(ops.merge_rollup(ops.rollup(df, "5m"), size))
        direct = ops.read_rollup(ops.rollup(df, size))
        key = ["labels", "timestamp", "value"]
        got, want = ([(str(r[0]), r[1], pytest.approx(r[2])) for r in sorted(rows(d, *key), key=str)] for d in (merged, direct))
        assert [g[:2] for g in got] == [w[:2] for w in want]
    # One hour with a single sample must weigh less in the day than one with two.
    df = points(spark, point("m", 0, 0), point("m", 0, 1), point("m", 3, 3600))
    assert rows(ops.read_rollup(ops.merge_rollup(ops.rollup(df, "1h"), "1d")), "value") == [(1.0,)]


def test_routing(spark):
    df = points(spark, point("m", 1, 0), point("m", 3, 60))
    tables = {"1m": df, **{s: ops.rollup(df, s) for s in ops.ROLLUP_SECONDS}}
    assert ops.routed_points(tables, at(0), at(3600)).count() == 2
    assert rows(ops.routed_points(tables, at(0), at(7200)), "value") == [(2.0,)]


def test_multi_window(spark):
    df = points(spark, point("m", 1, 0), point("m", 5, 61), point("m", 3, 3600 * 13))
    got = {(r["window_size"], r["bucket"].isoformat()): (r["sum"], r["count"], r["min"], r["max"], r["avg"]) for r in ops.multi_window_aggregate(df).collect()}
    assert got["1m", "2024-01-01T12:00:00"] == (1, 1, 1, 1, 1)
    assert got["5m", "2024-01-01T12:00:00"] == (6, 2, 1, 5, 3)
    assert got["1d", "2024-01-01T00:00:00"] == (6, 2, 1, 5, 3)
    assert got["1d", "2024-01-02T00:00:00"] == (3, 1, 3, 3, 3)
    assert len(got) == 3 + 2 + 2 + 2
    with pytest.raises(ValueError):
        ops.multi_window_aggregate(df, {"a": 60, "b": 90})


def test_listings(spark):
    df = points(
        spark, point("http_a", 1, x="1"), point("http_a", 1, 5, x="1"), point("http_a", 1, x="2", y=""), point("http%b", 1), point("z", 1, q="1")
    )
    assert rows(ops.list_series(df, "http_"), "name", "labels") == [("http_a", {"x": "1"}), ("http_a", {"x": "2", "y": ""})]
    assert ops.list_series(df, "http%").count() == 1
    assert ops.list_series(df, limit=2).count() == 2
    assert rows(ops.list_labels(df, "http_a")) == [("x",), ("y",)]
    assert rows(ops.list_label_values(df, "http_a", "x")) == [("1",), ("2",)]
    assert rows(ops.list_label_values(df, "http_a", "y")) == []
    assert rows(ops.search_metric_names(df, "http")) == [("http%b",), ("http_a",)]


def test_matrix(spark):
    df = points(spark, point("m", 2, 61, a="1"), point("m", 1, 0, a="1"), point("m", 7, 5, a="0"), point("m", 8, 6, a="0"))
    long = rows(ops.matrix_samples(df), "metric", "ts", "value")
    base = int(T0.timestamp())
    assert long == [
        ({"__name__": "m", "a": "0"}, base + 5, 7.0), ({"__name__": "m", "a": "0"}, base + 6, 8.0),
        ({"__name__": "m", "a": "1"}, base, 1.0), ({"__name__": "m", "a": "1"}, base + 61, 2.0),
    ]
    stepped = {r["series_key"]: [(v["ts"] - base, v["value"]) for v in r["values"]] for r in ops.query_matrix(df, at(0), at(100), 60).collect()}
    assert stepped == {'{"a":"0","__service__":"svc"}': [(0, 8.0)], '{"a":"1","__service__":"svc"}': [(0, 1.0), (60, 2.0)]}


def test_dashboard(spark):
    df = points(spark, point("m", 1, 0.5, a="1"), point("m", 2, a="2"), point("n", 3))
    got = rows(
        ops.dashboard_series(
            df, {"one": Selector("m", [("a", "=", "1")]), "all": Selector("m"), "bad": Selector("m", [("a", "?", "1")])}, at(0), at(1)
        ),
        "target", "value", "ts_ms",
    )
    base = int(T0.timestamp()) * 1000
    assert got == [("all", 1.0, base), ("all", 2.0, base), ("one", 1.0, base)]


def test_rate_by_hand(spark):
    # Ticks every 60 s, range 120 s.  Values 10, 30 (+20), 5 (reset: +5), 8 (+3).
    df = points(spark, point("c", 10, 0), point("c", 30, 60), point("c", 5, 100), point("c", 8, 180))
    got = vector(ops.rate(df, 120, 60, at(0), at(300)))
    assert got == {
        (60.0,): pytest.approx(20 / 60),
        (120.0,): pytest.approx(25 / 100),  # the sample at 0 is still inside: both ends count
        (180.0,): pytest.approx(8 / 120),  # 30, 5, 8: +5 +3
    }  # at 240 only the sample at 180 is left, with nothing to compare


def test_single_sample_has_no_rate(spark):
    assert vector(ops.rate(points(spark, point("c", 1, 0), point("c", 1, 0)), 60, 60, at(0), at(60))) == {}


@pytest.mark.parametrize("range_s, step_s", [(300, 60), (100, 60), (60, 300), (250, 70)])
def test_rate_against_brute_force_with_one_hot_series(spark, range_s, step_s):
    rng = random.Random(range_s)
    data = []
    for i in range(600):
        series = "hot" if i % 3 == 0 else str(rng.randrange(6))
        data.append((series, rng.randrange(0, 3000), float(rng.randrange(50))))
    df = points(spark, *[point("c", v, t, s=s) for s, t, v in data])
    base = int(T0.timestamp())
    want = {}
    for tick in range(-(-base // step_s) * step_s, base + 3001, step_s):
        seen = defaultdict(list)
        for s, t, v in data:
            if tick - range_s <= base + t <= tick:
                seen[s].append((t, v))
        for s, samples in seen.items():
            samples.sort()
            span = samples[-1][0] - samples[0][0]
            up = sum(b[1] - a[1] if b[1] >= a[1] else b[1] for a, b in zip(samples, samples[1:]))
            if span > 0:
                want[s, float(tick - base)] = up / span
    got = vector(ops.rate(df, range_s, step_s, at(0), at(3000)), "s")
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_sum_and_avg(spark):
    df = points(
        spark, point("m", 1, 0, a="x", b="1"), point("m", 5, 30, a="x", b="1"), point("m", 7, 10, a="x", b="2"),
        point("m", 100, 10, a="y", b="1"), point("m", 3, 60, a="x", b="1"),
    )
    stepped = ops.instant_vector(df, 60)
    assert vector(ops.aggregate_series(stepped, "sum", ["a"]), "a") == {("x", 0.0): 12, ("y", 0.0): 100, ("x", 60.0): 3}
    assert vector(ops.aggregate_series(stepped, "avg")) == {(0.0,): pytest.approx(112 / 3), (60.0,): 3}


def test_histogram_quantile_by_hand(spark):
    def buckets(seconds, **counts):
        names = {"a": "0.1", "b": "0.5", "c": "1", "inf": "+Inf"}
        return [point("h", v, seconds, le=names[k], job="j") for k, v in counts.items()]

    df = points(spark, *buckets(0, a=10, b=30, c=40, inf=40), *buckets(60, a=0, b=0, c=10, inf=100), *buckets(120, a=0, inf=0), *buckets(180, a=4, b=8))
    vec = ops.with_series(df)

    def q(p):
        return vector(ops.histogram_quantile(vec, p), "job")

    assert q(0.5)["j", 0.0] == pytest.approx(0.1 + 0.4 * (20 - 10) / 20)
    assert q(0.1)["j", 0.0] == pytest.approx(0.1 * 4 / 10)
    assert q(0.5)["j", 60.0] == 1.0  # in the +Inf bucket: the highest finite bound
    assert q(0.05)["j", 60.0] == pytest.approx(0.5 + 0.5 * 5 / 10)
    assert q(0.5)["j", 120.0] is None and q(0.5)["j", 180.0] is None


def test_histogram_points(spark):
    row = {**point("h", 0, 0, job="j"), "bucket_counts": [10, 20, 10, 0], "explicit_bounds": [0.1, 0.5, 1.0]}
    df = spark.createDataFrame([tuple(row.get(n) for n in HISTOGRAM_SCHEMA.fieldNames())], HISTOGRAM_SCHEMA)
    got = vector(ops.histogram_buckets(df), "job", "le")
    assert sorted(v for v in got.values()) == [10, 30, 40, 40] and got["j", "+Inf", 0.0] == 40
    assert vector(ops.histogram_quantile(ops.histogram_buckets(df), 0.5), "job") == {("j", 0.0): pytest.approx(0.3)}


def test_ratio(spark):
    top = ops.with_series(points(spark, point("a", 6, 0, x="1"), point("a", 6, 0, x="2"), point("a", 6, 60, x="1")))
    bottom = ops.with_series(points(spark, point("b", 3, 0, x="1"), point("b", 0, 0, x="2")))
    got = ops.vector_ratio(top, bottom).withColumn("name", F.lit(""))
    assert vector(got, "x") == {("1", 0.0): 2.0, ("2", 0.0): None}


def test_services_with_equal_labels_are_apart(spark):
    a = [point("m", 100 + i, 5 * i, service="a", k="x") for i in range(11)]
    b = [point("m", 1000 + i, 5 * i + 1, service="b", k="x") for i in range(11)]
    df = points(spark, *a, *b)
    got = ops.rate(df, 60, 60, at(0), at(60))
    assert sorted(round(r[0], 9) for r in rows(got, "value") if r[0] > 0) == [0.2, 0.2]
    last = ops.instant_vector(df, 3600)
    assert rows(ops.aggregate_series(last, "sum"), "value") == [(1120.0,)]
    apart = ops.aggregate_series(last, "sum", ["__service__"])
    assert sorted(rows(apart, "value")) == [(110.0,), (1010.0,)]
    assert ops.list_series(df).count() == 1


def test_no_limit_means_all(spark):
    df = points(spark, *[point("m", i, i, k=str(i)) for i in range(30)])
    for limit in (None, 0, -1):
        assert ops.select_points(df, Selector("m"), at(0), at(100), limit=limit).count() == 30
        assert ops.list_series(df, limit=limit).count() == 30
        assert ops.list_label_values(df, "m", "k", limit).count() == 30


def test_matrix_of_a_long_range_has_no_step_limit(spark):
    df = points(spark, *[point("m", i, 3600 * i) for i in range(40)])
    assert rows(ops.query_matrix(df, at(0), at(30 * 86400), 60).selectExpr("size(values) AS n"), "n") == [(40,)]
    assert ops.stepped_samples(df, at(0), at(30 * 86400), 60).count() == 40


def test_a_sorted_matrix_is_cut_into_small_ranges(spark):
    """Samples alike take few bytes in a shuffle; merging up to Spark's own size would sort millions in one task."""
    assert prepare_session(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "4m"
    every = points(spark, point("m", 1.0, a="x")).crossJoin(spark.range(0, 1_500_000, 1, 8)).drop("id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        shuffled = ops.matrix_samples(every.withColumn("value", F.rand(3)))
        assert shuffled.rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "true")
