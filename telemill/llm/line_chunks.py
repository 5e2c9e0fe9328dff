"""Line dedup by content-defined chunks of lines.

Lines are hashed (first 32 bits of their MD5); a rolling hash over the last ``SPAN`` line hashes ends a chunk where it
is divisible by ``DIVISOR``.  Boundaries depend on the lines around them only, so that inserted or lost lines shift no
later boundary.  Chunks of two or more lines that occur more than once in the corpus are candidates by hash and length, found
on rows without text; only their texts are then fetched and compared byte by byte (grouped on the text itself, with a
map-side minimum), and every occurrence but the first (smallest doc_id, then position) is removed.  Texts move twice:
once to the candidate places, once to the verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import WORD, hash32, whole, written

SPAN = 2
DIVISOR = 4
LEAST_LINES = 2
PRIME = 4294967291


def _ends(hashes: str) -> Column:
    """For every line whether its chunk ends with it: the last line, or where the rolling hash says so."""
    n = F.size(hashes)

    def end(_: Column, i: Column) -> Column:
        rolled = F.get(hashes, i)
        for back in range(1, SPAN):
            rolled = F.pmod(rolled * 31 + F.coalesce(F.get(hashes, i - back), F.lit(0)), F.lit(PRIME))
        return (i == n - 1) | (F.pmod(rolled, F.lit(DIVISOR)) == 0)

    return F.transform(hashes, end)


def chunked(docs: DataFrame, *carried: str) -> DataFrame:
    """_id, _lines, _chunks (array of start and n over the lines of each text, 0-based) and the carried columns."""
    lines = docs.select(F.col("doc_id").alias("_id"), *carried, F.split(whole(), "\n").alias("_lines"))
    hashed = lines.withColumn("_hashes", F.transform("_lines", hash32))
    ends = hashed.withColumn("_ends", _ends("_hashes"))
    stops = ends.withColumn(
        "_stops", F.filter(F.transform("_ends", lambda e, i: F.when(e, i + 1)), lambda x: x.isNotNull())
    ).drop("_hashes", "_ends")
    begin = lambda i: F.coalesce(F.get("_stops", i - 1), F.lit(0))
    return stops.withColumn(
        "_chunks", F.transform("_stops", lambda s, i: F.struct(begin(i).alias("start"), (s - begin(i)).alias("n")))
    ).drop("_stops")


def _many(rows: DataFrame, *values: Column) -> DataFrame:
    """One row per multi-line chunk that holds a word: _id, _at and values of its text, column ``_chunk``."""
    parts = F.transform(
        F.filter("_chunks", lambda c: c["n"] >= LEAST_LINES),
        lambda c: F.struct(c["start"].alias("at"), F.array_join(F.slice("_lines", c["start"] + 1, c["n"]), "\n").alias("text")),
    )
    chunks = rows.select("_id", F.explode(parts).alias("_p"))
    chunks = chunks.select("_id", F.col("_p.at").alias("_at"), F.col("_p.text").alias("_chunk"))
    return chunks.filter(F.col("_chunk").rlike(WORD)).select("_id", "_at", *values)


def _by_document(places: DataFrame, name: str) -> DataFrame:
    """The places of each document, as ``name``; to be merged by id, like documents of any number."""
    return places.groupBy("_id").agg(F.collect_set("_at").alias(name)).withColumnRenamed("_id", "_of").hint("merge")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """_id, _at of every chunk that occurs earlier too.  Chunks without a word are left alone."""
    key = (F.xxhash64("_chunk").alias("_hash"), F.octet_length("_chunk").alias("_size"))
    hashes = written(_many(chunked(docs), *key), "chunk-hashes")
    often = hashes.groupBy("_hash", "_size").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash", "_size")
    maybe = _by_document(hashes.join(often, ["_hash", "_size"], "left_semi"), "_ats")
    rows = docs.select("doc_id", "text").join(maybe, F.col("doc_id").eqNullSafe(F.col("_of")))
    rows = chunked(rows, "_ats").withColumn("_chunks", F.filter("_chunks", lambda c: F.array_contains("_ats", c["start"])))
    texts = written(_many(rows, key[0], F.col("_chunk")), "chunk-texts")
    # Grouped on the text itself: equal hashes of unequal texts stay apart.
    first = texts.groupBy("_hash", "_chunk").agg(F.min(F.struct("_id", "_at")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = written(first.filter("_n > 1").drop("_n"), "chunk-firsts")
    joined = texts.join(first, ["_hash", "_chunk"])
    return joined.filter(F.struct("_id", "_at") != F.col("_first")).select("_id", "_at")


def drop_repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text (what stays, lines joined by a newline), n_lines, n_chunks, n_removed (chunks), n_removed_lines.

    One row per row of ``docs``; a null text counts as empty, which is one empty line.  Rows that repeat an id are told
    apart by neither id nor place and count as one occurrence.  Null ids rank first.  Other columns are not read.
    """
    gone = _by_document(repeated_chunks(docs), "_gone")
    rows = docs.select("doc_id", "text").join(gone, F.col("doc_id").eqNullSafe(F.col("_of")), "left")
    none = F.array().cast("array<int>")
    stay = F.filter("_chunks", lambda c: ~F.array_contains(F.coalesce("_gone", none), c["start"]))
    kept = chunked(rows, "_gone").withColumn("_stay", stay)
    text = F.array_join(F.flatten(F.transform("_stay", lambda c: F.slice("_lines", c["start"] + 1, c["n"]))), "\n")
    left = F.aggregate("_stay", F.lit(0), lambda a, c: a + c["n"])
    return kept.select(
        F.col("_id").alias("doc_id"),
        text.alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_chunks").cast("long").alias("n_chunks"),
        (F.size("_chunks") - F.size("_stay")).cast("long").alias("n_removed"),
        (F.size("_lines") - left).cast("long").alias("n_removed_lines"),
    )
