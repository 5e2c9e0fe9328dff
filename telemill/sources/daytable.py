"""Tables by day with a manifest: batches append, compaction and expiry swap days, readers see whole versions.

Rows lie in ``<path>/data/_date=<day>/commit=<name>/``.  A manifest names, for every day, the commits that belong to the
table, and for every source the number of its last batch.  Each version of the manifest is a small JSON file that
appears by one rename, and a version that exists is never replaced; so a reader sees all of a commit or nothing, a
failed writer leaves files nobody reads, and of two writers that started from one version the second tries again.

* A batch whose number is not above its source's last one has been committed before and is left out, so a stream may
  deliver batches again, and a neighbour's failure costs a sink nothing.
* Reading a range lists and opens the commits of its own days alone, whatever the number of batches.
* Compaction rewrites the days that have many commits, each to files of about a target size, and swaps them in.
* Expiry drops days from the manifest.  ``vacuum`` removes files no version that is kept names.
* A table with a ``key`` finds the rows of one key without reading its days.  Every commit comes with a list of its
  (key, day) pairs, sorted and dealt to folders by a hash of the key, and with Bloom filters on the key in its files; so a
  lookup opens one folder of each commit's list, then only the days and commits that hold the key.

What the manifest holds grows with days and with commits since the last compaction.  Renaming without replacing must be
atomic in the file system, as in HDFS and local ones.
"""

from __future__ import annotations

import copy
import json
import uuid
import zlib
from collections.abc import Callable, Iterable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from telemill.functions.timegrid import micros, prune_days

TARGET_BYTES = 128 << 20
#: Rows a task of compaction sorts, about.  Files are compressed, sorted signals down to a few bytes a row, so the
#: size of the files alone does not tell how much room their rows take.
TARGET_ROWS = 1_000_000
#: Cells a day of a batch is dealt to before it is sorted.
CELLS = 16
KEPT_VERSIONS = 10
#: Folders a commit's list of keys is dealt to; part of the folders' names, so it may change between commits.
KEY_FOLDERS = 64

Merge = Callable[[DataFrame], DataFrame]


class Files:
    """The few file operations a manifest needs, on whatever file system a path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def found(self, pattern: str) -> list[str]:
        return sorted(s.getPath().toString() for s in self.fs.globStatus(self.path(pattern)) or [])

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that appears whole; False if there is one of that name."""
        hidden = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(hidden), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        options = self.gateway.new_array(getattr(fs, "Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").NONE
        context = fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self.path(hidden)), self.fs.makeQualified(self.path(path)), options)
        except Exception as error:
            self.delete(hidden)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self.path(folder)).getLength()

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def _day(value) -> str:
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros(value))).date().isoformat()


class Ledger:
    """Versions of a small document, each a file of its own; ``batches`` in it holds the last batch by source."""

    def __init__(self, files: Files, folder: str):
        self.files, self.folder = files, folder

    def versions(self) -> list[str]:
        return [n for n in self.files.names(self.folder) if n.endswith(".json")]

    def load(self, name: str) -> dict:
        return json.loads(self.files.read(f"{self.folder}/{name}"))

    def latest(self) -> dict:
        names = self.versions()
        return self.load(names[-1]) if names else {"version": 0, "batches": {}}

    def change(self, change: Callable[[dict], dict | None]) -> bool:
        """Make the next version from the latest one, again if another writer was faster.  None changes nothing."""
        while True:
            latest = self.latest()
            following = change(copy.deepcopy(latest))
            if following is None:
                return False
            following["version"] = latest["version"] + 1
            if self.files.create(f"{self.folder}/{following['version']:012d}.json", json.dumps(following)):
                return True

    @staticmethod
    def knows(document: dict, source: str | None, batch_id: int | None) -> bool:
        """Whether a batch of a source has been committed."""
        return source is not None and batch_id <= document["batches"].get(source, -1)


class DayTable:
    """A table of rows with a time column, stored by UTC day; ``sort`` is the order inside a file.

    ``key`` names a string column, such as a trace's id, by which :meth:`lookup` finds rows of any day.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, time_column: str, sort: Iterable[str] = (), key: str | None = None
    ):
        self.spark, self.path, self.time_column, self.sort, self.key = spark, path.rstrip("/"), time_column, list(sort), key
        self.schema = StructType([f for f in schema.fields if f.name not in ("_date", "commit")])
        self.files = Files(spark, self.path)
        self.ledger = Ledger(self.files, f"{self.path}/manifest")

    def manifest(self) -> dict:
        """The latest version: its number, commits by day, last batch by source."""
        return {"days": {}, **self.ledger.latest()}

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        return self.ledger.change(lambda latest: change({"days": {}, **latest}))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """A batch dealt by day and a hash of the sort columns, so that no task sorts a whole piece of the input.

        The hint lets AQE merge small shares and split large ones; without AQE the rows stay where they are.
        """
        cell = F.pmod(F.xxhash64(*(self.sort or [self.time_column])), F.lit(CELLS))
        placed = rows.select(*self.schema.names, F.to_date(self.time_column).alias("_date"), cell.alias("_cell"))
        return placed.hint("rebalance", "_date", "_cell")

    def _write(self, rows: DataFrame, name: str) -> list[str]:
        """Write rows as one commit that no version names yet; the days it has rows of."""
        dated = rows.select(*self.schema.names).withColumn("_date", F.to_date(self.time_column)).withColumn("commit", F.lit(name))
        order = ["_date", *self.sort]
        writer = dated.sortWithinPartitions(*order).write.mode("append").partitionBy("_date", "commit")
        if self.key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{self.key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.path}/data")
        touched = [folder.split("/")[-2][6:] for folder in self.files.found(f"{self.path}/data/_date=*/commit={name}")]
        if self.key and touched:
            self._write_keys({day: [name] for day in touched}, name)
        return touched

    def _write_keys(self, commits: dict[str, list[str]], name: str) -> None:
        """List the keys of a commit with their days, from the files just written, of which only the key is read."""
        pairs = self._of(commits).select(F.col(self.key).alias("key"), F.col("_date").alias("day")).filter("key IS NOT NULL").distinct()
        folder = F.pmod(F.crc32(F.encode("key", "UTF-8")), F.lit(KEY_FOLDERS)).cast("int")
        placed = pairs.select("key", "day", F.lit(name).alias("commit"), F.lit(KEY_FOLDERS).alias("of"), folder.alias("folder"))
        dealt = placed.repartitionByRange("folder", "key").sortWithinPartitions("folder", "key", "day")
        dealt.write.mode("append").partitionBy("commit", "of", "folder").parquet(f"{self.path}/keys")

    def append(self, rows: DataFrame, source: str | None = None, batch_id: int | None = None) -> bool:
        """Add a batch; False if this batch of the source is in the table already."""

        if Ledger.knows(self.manifest(), source, batch_id):
            return False
        name = uuid.uuid4().hex
        touched = self._write(self._dealt(rows), name)

        def change(manifest: dict) -> dict | None:
            if Ledger.knows(manifest, source, batch_id):
                return None
            for day in touched:
                manifest["days"].setdefault(day, []).append(name)
            if source is not None:
                manifest["batches"][source] = batch_id
            return manifest

        return self._commit(change)

    def _of(self, commits: dict[str, list[str]]) -> DataFrame:
        full = StructType([*self.schema.fields, StructField("_date", DateType())])
        paths = [f"{self.path}/data/_date={day}/commit={name}" for day, names in sorted(commits.items()) for name in names]
        if not paths:
            return self.spark.createDataFrame([], full)
        reader = self.spark.read.schema(StructType([*full.fields, StructField("commit", StringType())])).option("basePath", f"{self.path}/data")
        return reader.parquet(*paths).drop("commit")

    def days(self, start=None, end=None) -> dict[str, list[str]]:
        """The commits of the days that a range touches."""
        low = "0000" if start is None else _day(start)
        high = "9999-99" if end is None else _day(end)
        return {day: names for day, names in self.manifest()["days"].items() if low <= day <= high}

    def read(self, start=None, end=None) -> DataFrame:
        """Rows of a range of time (both ends included), with ``_date``."""
        rows = self._of(self.days(start, end))
        if start is None and end is None:
            return rows
        return prune_days(rows, self.time_column, "0001-01-01" if start is None else start, "9999-12-31" if end is None else end)

    def holding(self, key: str) -> dict[str, list[str]]:
        """The commits of the days that hold a key; those without a list of keys (written before it had one) all do.

        What comes to the driver are pairs of a day and a commit, which the manifest names anyway.
        """
        if self.key is None:
            raise ValueError("the table has no key")
        named = self.manifest()["days"]
        live = {name for names in named.values() for name in names}
        listed, paths = set(), []
        for folder in self.files.found(f"{self.path}/keys/commit=*/of=*"):
            name, of = (part.split("=")[1] for part in folder.split("/")[-2:])
            if name in live:
                listed.add(name)
                paths += self.files.found(f"{folder}/folder={zlib.crc32(key.encode()) % int(of)}")
        found = set()
        if paths:
            lists = self.spark.read.schema("key string, day date, commit string").option("basePath", f"{self.path}/keys").parquet(*paths)
            hits = lists.filter(F.col("key") == key).select(F.col("day").cast("string").alias("day"), "commit").distinct()
            found = {(row["day"], row["commit"]) for row in hits.collect()}
        held = {day: [n for n in names if n not in listed or (day, n) in found] for day, names in named.items()}
        return {day: names for day, names in held.items() if names}

    def lookup(self, key: str) -> DataFrame:
        """The rows of one key, whatever their day, with ``_date``; none if no row has it."""
        return self._of(self.holding(key)).filter(F.col(self.key) == key)

    def compact(
        self, merge: Merge | None = None, least_commits: int = 2, target_bytes: int = TARGET_BYTES, target_rows: int = TARGET_ROWS
    ) -> list[str]:
        """Rewrite the days with at least so many commits; the days rewritten.

        A file gets about ``target_bytes`` or ``target_rows``, whichever comes first.  ``merge`` folds the rows of a day,
        as for tables of mergeable states.  Batches that are appended meanwhile stay.
        """
        old = {day: names for day, names in self.manifest()["days"].items() if len(names) >= least_commits}
        if not old:
            return []
        size = sum(self.files.size(f"{self.path}/data/_date={day}/commit={name}") for day, names in old.items() for name in names)
        rows = self._of(old)
        ranges = max(1, -(-size // target_bytes), -(-rows.count() // target_rows))
        rows = merge(rows.drop("_date")) if merge else rows
        dated = rows.select(*self.schema.names).withColumn("_date", F.to_date(self.time_column))
        name = uuid.uuid4().hex
        # the sort columns cut a large day into several ranges; the days themselves are sorted apart
        dealt = dated.repartitionByRange(ranges, "_date", *self.sort)
        touched = set(self._write(dealt, name))

        def change(manifest: dict) -> dict:
            for day, names in old.items():
                left = [n for n in manifest["days"].get(day, []) if n not in names]
                gone = not set(names) <= set(manifest["days"].get(day, []))
                if gone:  # expired or compacted by somebody else meanwhile
                    continue
                manifest["days"][day] = ([name] if day in touched else []) + left
                if not manifest["days"][day]:
                    del manifest["days"][day]
            return manifest

        self._commit(change)
        return sorted(old)

    def expire(self, as_of, days: int) -> list[str]:
        """Drop the days of which every row is older than ``days`` before ``as_of``; no row is read.

        Rows of the day that straddles the limit stay until it is over; ``apply_retention`` leaves them out when read.
        """
        limit = (date.fromisoformat(_day(as_of)) - timedelta(days=days)).isoformat()
        expired = [day for day in self.manifest()["days"] if day < limit]
        if expired:
            self._commit(lambda m: m | {"days": {day: names for day, names in m["days"].items() if day >= limit}})
        return sorted(expired)

    def vacuum(self, keep: int = KEPT_VERSIONS) -> int:
        """Remove commits that none of the last ``keep`` versions names, and older versions; the commits removed.

        No writer may be at work, as its commit is named only at its end.
        """
        versions = self.ledger.versions()
        kept = [self.ledger.load(n) for n in versions[-keep:]]
        named = {(day, name) for m in kept for day, names in m.get("days", {}).items() for name in names}
        removed = 0
        for folder in self.files.found(f"{self.path}/data/_date=*/commit=*"):
            day, name = (part.split("=")[1] for part in folder.split("/")[-2:])
            if (day, name) not in named:
                self.files.delete(folder)
                removed += 1
        commits = {name for _, name in named}
        for folder in self.files.found(f"{self.path}/keys/commit=*"):
            if folder.rsplit("=", 1)[1] not in commits:
                self.files.delete(folder)
        for old in versions[:-keep]:
            self.files.delete(f"{self.path}/manifest/{old}")
        return removed


class MaintainedView:
    """A table of mergeable states, kept up batch by batch.

    Every batch appends its own states, once however often it is delivered; late rows touch the days they belong to.
    Reading merges what batches have left, compaction merges it for good.
    """

    def __init__(self, table: DayTable, states: Merge, merge: Merge):
        self.table, self.states, self.merge = table, states, merge

    def fold(self, batch: DataFrame, source: str, batch_id: int) -> bool:
        """Fold a batch in; False if it is in already."""
        return self.table.append(self.states(batch), source, batch_id)

    def read(self, start=None, end=None) -> DataFrame:
        return self.merge(self.table.read(start, end).drop("_date"))

    def compact(self, least_commits: int = 2) -> list[str]:
        return self.table.compact(self.merge, least_commits)
