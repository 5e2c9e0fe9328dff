"""Day tables: manifest, replays, compaction, expiry; maintained views; topics; sinks that fail."""

import json
import os
import random

import pytest
from conftest import at, log, logs, point, points, rows
from pyspark.sql import functions as F

from telemill.operators import metrics
from telemill.operators.logs import severity_counts
from telemill.schemas import LOG_SCHEMA, METRIC_SCHEMA
from telemill.sources import rollups, tables, topics
from telemill.sources.daytable import DayTable, Files

DAY = 86400


def bodies(df):
    return sorted(r["body"] for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return DayTable(spark, str(tmp_path / "logs"), LOG_SCHEMA, "timestamp", ["service_name", "timestamp"])


def batch(spark, *bodies_and_days):
    return logs(spark, *[log(body, seconds=day * DAY) for body, day in bodies_and_days])


def test_batches_replays_and_days(spark, table):
    assert table.read().count() == 0 and table.read(at(0), at(DAY)).columns[-1] == "_date"
    assert table.append(batch(spark, ("a", 0), ("b", 1)), "s", 0)
    assert table.append(batch(spark, ("c", 0)), "s", 1)
    assert not table.append(batch(spark, ("c", 0)), "s", 1)  # delivered again
    assert not table.append(batch(spark, ("a", 0)), "s", 0)
    assert table.append(batch(spark, ("d", 2)), "other", 0)  # another source counts for itself
    assert table.append(batch(spark, ("e", 0)))  # no source: a load
    assert bodies(table.read()) == list("abcde")
    assert bodies(table.read(at(-3600), at(3600))) == list("ace")
    assert {day: len(names) for day, names in table.days().items()} == {"2024-01-01": 3, "2024-01-02": 1, "2024-01-03": 1}


def test_a_range_opens_its_own_files(spark, table):
    for i in range(6):
        table.append(batch(spark, (f"x{i}", i % 3)), "s", i)
    read = table.read(at(DAY - 3600), at(DAY + 3600))
    assert len(read.inputFiles()) == 2 and all("_date=2024-01-02" in f for f in read.inputFiles())


@pytest.fixture
def keyed(spark, tmp_path):
    return DayTable(spark, str(tmp_path / "keyed"), LOG_SCHEMA, "timestamp", ["service_name", "timestamp"], "trace_id")


def traced(spark, *ids_and_days):
    return logs(spark, *[log(f"{i}@{day}", seconds=day * DAY, trace_id=i) for i, day in ids_and_days]).coalesce(1)


def test_a_lookup_opens_few_files_of_many_days(spark, keyed):
    """One trace over two of thirty days, in batches with late rows: two data files are opened, before and after compaction."""
    for i in range(3):
        days = range(i, 30, 3)
        keyed.append(traced(spark, *[(f"t{day}-{n}", day) for day in days for n in range(20)], *[("wide", day) for day in days if day in (4, 20)]), "s", i)
    keyed.append(traced(spark, ("late", 4), ("é", 5), (None, 6)), "s", 3)
    for _ in range(2):
        found = keyed.lookup("wide")
        assert bodies(found) == ["wide@20", "wide@4"] and len(found.inputFiles()) == 2 and found.columns[-1] == "_date"
        assert bodies(keyed.lookup("late")) == ["late@4"] and len(keyed.lookup("late").inputFiles()) == 1
        assert bodies(keyed.lookup("é")) == ["é@5"]
        assert keyed.lookup("nobody").count() == 0 and keyed.lookup("nobody").inputFiles() == []
        assert len(keyed.read().inputFiles()) >= 30
        keyed.compact()
    keyed.expire(at(40 * DAY), 30)
    assert bodies(keyed.lookup("wide")) == ["wide@20"]
    keyed.vacuum(1)
    assert bodies(keyed.lookup("wide")) == ["wide@20"] and keyed.holding("late") == {}


def test_files_of_a_keyed_table_hold_bloom_filters(spark, keyed):
    """More different keys than a dictionary page takes, so that the filter is what leaves a file out."""
    ids = spark.range(0, 200_000).selectExpr("md5(cast(id AS string)) AS trace_id")
    rows = logs(spark, log("x")).drop("trace_id").crossJoin(ids).select(*LOG_SCHEMA.names)
    keyed.append(rows.coalesce(1))
    path = keyed.read().inputFiles()[0]
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(keyed.files.path(path), keyed.files.conf)
    )
    try:
        block = reader.getFooter().getBlocks().get(0)
        offsets = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in block.getColumns()}
    finally:
        reader.close()
    assert offsets["trace_id"] > 0 and offsets["body"] <= 0


def test_lookup_reads_commits_that_have_no_list(spark, table, keyed):
    """Batches from before the table had a key are read whole; a table without a key refuses."""
    old = DayTable(spark, keyed.path, LOG_SCHEMA, "timestamp")
    old.append(traced(spark, ("a", 0), ("b", 1)))
    keyed.append(traced(spark, ("a", 2), ("c", 3)))
    assert bodies(keyed.lookup("a")) == ["a@0", "a@2"] and len(keyed.lookup("a").inputFiles()) == 3
    with pytest.raises(ValueError):
        old.lookup("a")


def test_a_batch_that_lost_its_race_is_not_looked_up(spark, keyed):
    keyed.append(traced(spark, ("a", 0)), "s", 0)
    keyed._write(traced(spark, ("a", 1)), "unnamed")
    assert bodies(keyed.lookup("a")) == ["a@0"]
    keyed.vacuum()
    assert keyed.files.found(f"{keyed.path}/keys/commit=unnamed") == []


def test_what_a_failed_writer_left_is_never_read(spark, table):
    table.append(batch(spark, ("kept", 0)), "s", 0)
    table._write(batch(spark, ("lost", 0)), "unnamed")  # and then the writer died
    assert bodies(table.read()) == ["kept"]
    assert table.append(batch(spark, ("lost", 0)), "s", 1)
    assert bodies(table.read()) == ["kept", "lost"]
    assert table.vacuum() == 1 and bodies(table.read()) == ["kept", "lost"]


def test_two_writers_lose_nothing(spark, table, tmp_path):
    """A version that exists is not replaced: the slower writer starts again from it."""
    other = DayTable(spark, table.path, LOG_SCHEMA, "timestamp")
    table.append(batch(spark, ("first", 0)), "a", 0)
    original, raced = other.ledger.files.create, []

    def slow(path, text):
        if not raced:
            raced.append(table.append(batch(spark, ("between", 0)), "b", 0))
        return original(path, text)

    other.ledger.files.create = slow
    assert other.append(batch(spark, ("last", 0)), "c", 0)
    assert bodies(table.read()) == ["between", "first", "last"] and raced == [True]
    assert table.manifest()["version"] == 3 and set(table.manifest()["batches"]) == {"a", "b", "c"}
    files = Files(spark, str(tmp_path / "f"))
    assert files.create(str(tmp_path / "f/x"), "1") and not files.create(str(tmp_path / "f/x"), "2")
    assert files.read(str(tmp_path / "f/x")) == "1"


def test_compaction_after_many_small_batches(spark, table):
    want = []
    for i in range(12):
        own = [(f"m{i}", i % 2), (f"n{i}", 0)]
        want += [b for b, _ in own]
        table.append(batch(spark, *own).coalesce(1), "s", i)
    assert max(len(n) for n in table.days().values()) == 12
    before = table.read()
    assert table.compact() == ["2024-01-01", "2024-01-02"]
    assert {len(n) for n in table.days().values()} == {1}
    assert len(table.read().inputFiles()) <= 4
    assert bodies(table.read()) == sorted(want) == bodies(before)  # a reader of the old version goes on
    assert table.compact() == []
    assert table.vacuum(keep=1) == 18 and bodies(table.read()) == sorted(want)


def test_compaction_keeps_what_came_meanwhile(spark, table):
    table.append(batch(spark, ("a", 0)), "s", 0)
    table.append(batch(spark, ("b", 0)), "s", 1)
    write = table._write

    def late(rows, name):
        found = write(rows, name)
        if len(table.manifest()["batches"]) and table.manifest()["batches"]["s"] == 1:
            table._write = write
            table.append(batch(spark, ("c", 0)), "s", 2)
        return found

    table._write = late
    table.compact()
    assert bodies(table.read()) == ["a", "b", "c"]


def test_expiry_drops_days_and_retention_the_rest(spark, table):
    data = [(f"d{d}", d) for d in range(-9, 1)] + [("edge", -7 + 0.25)]
    table.append(batch(spark, *data), "s", 0)
    assert table.expire(at(0), 7) == ["2023-12-23", "2023-12-24"]
    assert bodies(table.read()) == sorted(b for b, d in data if d >= -7)
    kept = tables.apply_retention(table.read(), tables.LOGS, at(0), 7)
    assert bodies(kept) == sorted(b for b, d in data if d > -7)
    assert table.expire(at(0), 7) == [] and table.vacuum(1) == 2


def test_views_replays_late_rows_and_compaction(spark, tmp_path):
    rng = random.Random(1)
    data = [point("m", float(rng.randrange(50)), rng.randrange(3 * DAY), a=str(rng.randrange(3))) for _ in range(200)]
    late = [point("m", 7.0, 10, a="0"), point("new", 1.0, 20)]
    views = rollups.rollup_views(spark, str(tmp_path / "views"))
    fold = rollups.fold_all(list(views.values()), "s")
    batches = [points(spark, *part) for part in (data[:80], data[80:], late)]
    for i, b in ((0, batches[0]), (1, batches[1]), (1, batches[1]), (0, batches[0]), (2, batches[2]), (2, batches[2])):
        fold(b, i)
        if i == 1:
            views["1h"].compact()
    whole = points(spark, *data, *late)
    columns = ["name", "service_name", "labels", "bucket", "value_sum", "value_cnt"]
    for size, view in views.items():
        want = sorted(rows(metrics.rollup(whole, size), *columns), key=str)
        assert sorted(rows(view.read(), *columns), key=str) == want
        view.compact()
        assert sorted(rows(view.read(), *columns), key=str) == want
        assert view.table.read().count() == len(want)  # merged for good


def test_a_crash_between_views_is_made_good_by_the_replay(spark, tmp_path):
    views = rollups.rollup_views(spark, str(tmp_path / "views"))
    df = points(spark, point("m", 1.0, 0), point("m", 2.0, 400))
    views["5m"].fold(df, "s", 0)  # and then the driver died
    rollups.fold_all(list(views.values()), "s")(df, 0)
    assert [view.read().agg(F.sum("value_sum")).first()[0] for view in views.values()] == [3.0, 3.0, 3.0]


def test_severity_view(spark, tmp_path):
    df = logs(spark, *[log(severity=9 + i % 2, seconds=i * 7, service=f"s{i % 2}") for i in range(60)])
    view = rollups.severity_view(spark, str(tmp_path / "counts"))
    for i in range(3):
        view.fold(df.filter(f"pmod(unix_seconds(timestamp), 3) = {i}"), "s", i)
    columns = ["service_name", "severity", "bucket", "cnt"]
    assert sorted(rows(view.read(), *columns)) == sorted(rows(severity_counts(df), *columns))


def test_a_stream_into_table_view_and_topic_where_one_sink_fails(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(3):
        points(spark, *[point("m", float(i), 60 * i + part, a=str(part)) for i in range(20)]).coalesce(1).write.mode("append").parquet(source)
    table = rollups.metric_table(spark, str(tmp_path / "table"))
    views = rollups.rollup_views(spark, str(tmp_path / "views"))
    topic = topics.FileTopic(spark, str(tmp_path / "topic"), "name")
    failed = []

    def flaky(rows_, batch_id):
        table.append(rows_, "q", batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost")

    def query():
        stream = spark.readStream.schema(METRIC_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        sinks = tables.fan_out([flaky, rollups.fold_all(list(views.values()), "q"), topic.writer("q")])
        return stream.writeStream.foreachBatch(sinks).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost"):
        query().awaitTermination()
    query().awaitTermination()
    assert failed and table.read().count() == 60
    assert views["1d"].read().agg(F.sum("value_cnt")).first()[0] == 60
    assert topics.decode_metrics(topic.read()).count() == 60
    parts = topic.read().groupBy("key").agg(F.countDistinct("partition").alias("n"))
    assert {r["n"] for r in parts.collect()} == {1}


def test_routes(spark, tmp_path):
    views = rollups.rollup_views(spark, str(tmp_path / "views"))
    table = rollups.metric_table(spark, str(tmp_path / "table"))
    df = points(spark, *[point("m", float(i), 60 * i) for i in range(2000)])
    table.append(df)
    rollups.fold_all(list(views.values()), "s")(df, 0)
    for seconds, width in ((3600, 60), (3 * 3600, 300), (8 * 3600, 3600), (25 * 3600, 86400)):
        got = rows(rollups.routed_points(table, views, at(0), at(seconds)), F.unix_seconds("timestamp"), "value")
        start = int(at(0).timestamp())
        assert got and all(t % width == 0 and start <= t <= start + seconds for t, _ in got)


def test_manifest_is_plain_json(spark, table):
    table.append(batch(spark, ("a", 0)), "s", 4)
    folder = f"{table.path}/manifest"
    (name,) = [n for n in os.listdir(folder) if n.endswith(".json") and not n.startswith(".")]
    with open(f"{folder}/{name}") as file:
        document = json.load(file)
    assert document["version"] == 1 and document["batches"] == {"s": 4} and list(document["days"]) == ["2024-01-01"]


def test_no_task_sorts_a_whole_batch_or_table(spark, tmp_path):
    """Rows that compress well are many in few bytes: neither the input's pieces nor the size of files bound a task."""
    table = DayTable(spark, str(tmp_path / "wide"), LOG_SCHEMA, "timestamp", ["service_name", "timestamp"])
    own = logs(spark, *[log("same", seconds=i) for i in range(400)]).coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.append(own, "s", 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(table.read().inputFiles()) > 1  # one task held the rows, several sorted them
    table.append(own, "s", 1)
    assert table.compact(target_rows=100) == ["2024-01-01"]
    assert len(table.read().inputFiles()) > 4 and table.read().count() == 800
