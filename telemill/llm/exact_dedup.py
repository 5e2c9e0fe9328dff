"""Exact duplicates by a tree merge of digest runs.

Every document becomes one narrow row: two digests and the length of its normalised text (A-Z lower-cased, nothing
else).  Rows start in ``FAN_IN ** ROUNDS`` runs by a hash of their id.  In each round the runs that share a parent are
merged: equal (SHA-256, second digest, length) become one entry that carries the count and the id that stays.  So a
group that holds a third of all rows has shrunk to at most one entry per run before its last exchange, and every round
is an ordinary aggregation with a map-side combine.  Two texts count as equal only if all three values agree at every
level; the verdicts are then joined back to the rows, which Spark may split if one digest is frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import ascii_lower, whole, written

FAN_IN = 8
ROUNDS = 2
KEY = ["_sha", "_check", "_bytes"]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digests of the normalised text."""
    norm = docs.select("doc_id", ascii_lower(whole()).alias("_norm"))
    return norm.select(
        "doc_id",
        F.unhex(F.sha2("_norm", 256)).alias("_sha"),
        F.xxhash64("_norm").alias("_check"),
        F.octet_length("_norm").alias("_bytes"),
    )


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN, rounds: int = ROUNDS) -> DataFrame:
    """One entry per distinct text: its key, the largest id as keep_id, and group_size."""
    runs = rows.select(
        *KEY,
        F.pmod(F.xxhash64("doc_id"), F.lit(fan_in**rounds)).alias("_run"),
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
    )
    for level in range(rounds + 1):
        if level:
            runs = runs.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("long"))
        runs = runs.groupBy(*KEY, "_run").agg(
            F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        )
    return runs.drop("_run")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``, dropped ones too.

    Of equal texts the largest doc_id stays.  A null text counts as empty; a null doc_id ranks below all others.  Rows
    that repeat both id and text are counted, and share their verdict.  Other columns are not read.  No rows give none.
    """
    rows = written(digests(docs), "exact-digests")
    repeated = written(merge_runs(rows).filter("group_size > 1"), "exact-groups")
    joined = rows.join(repeated, KEY, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Rows are matched by id and text."""
    dropped = exact_groups(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.unhex("text_sha256").alias("_same"))
    same = F.unhex(F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)) == dropped["_same"]
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["_gone"]) & same, "left_anti")
