"""Quality rules: counts per document, and lines that many documents of one host share.

All rules are column expressions.  Lines are normalised (A-Z lower-cased, white space runs to one space, trimmed) and
hashed; per host (the ``source`` column, null being a host of its own) the distinct texts that hold a line are
counted.  A line is above the limit if more than ``SHARE`` of the host's texts hold it, and more than ``MIN_TEXTS``, so
that a few texts that agree by chance make no line frequent on a small host.  Its first holder (smallest doc_id) keeps
it, all others lose it; copies of one text count as one text, so copying alone makes no line frequent.  A document that
keeps fewer than ``KEEP_SHARE`` of its words, or fewer than
``LEAST_WORDS``, is depleted and rejected.

A host has at most (lines per text) / SHARE lines above the limit, so they fit one row per host, and the lines of the
documents are shuffled only once, as hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import WORD, ascii_lower, whole, words_of, written

MIN_TEXTS = 3
SHARE = 0.05
LEAST_WORDS = 20
KEEP_SHARE = 0.3
WINDOW = 8
REPEATED_PERCENT = 30


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), r"[\x20\x09-\x0D]+", " "))


def base_rules(docs: DataFrame, *carried: Column) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, after the carried columns."""
    text = whole()
    names = [f"_c{i}" for i in range(len(carried))]
    words = docs.select(
        *[c.alias(n) for c, n in zip(carried, names)],
        words_of(text).alias("_words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _lines(text).alias("_lines"),
    )
    hashed = words.select(
        *names,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    windows = hashed.withColumn(
        "_windows",
        F.when(
            F.size("_hashes") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)),
            ),
        ).otherwise(F.array().cast("array<long>")),
    ).drop("_hashes")
    # Only documents with a repeated window are sorted.
    ordered = windows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
        ),
    ).drop("_windows")
    places = ordered.withColumn(
        "_places",
        F.sort_array(
            F.transform(
                F.filter(
                    "_sorted",
                    lambda x, i: (F.get("_sorted", i - 1)["h"].eqNullSafe(x["h"]))
                    | (F.get("_sorted", i + 1)["h"].eqNullSafe(x["h"])),
                ),
                lambda x: x["at"],
            )
        ),
    ).drop("_sorted")
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda s, at: F.struct(
            (at + WINDOW).alias("to"), (s["n"] + at + WINDOW - F.greatest(at, s["to"])).alias("n")
        ),
        lambda s: s["n"],
    )
    counted = places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return counted.select(
        *[F.col(n) for n in names],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (
            (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
        ).alias("base_failed"),
    )


def frequent_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE) -> DataFrame:
    """One row per host that has lines above its limit: _host, _frequent (line hashes), _holders (their first ids)."""
    rows = docs.select(
        F.col("source").alias("_host"), F.col("doc_id").alias("_id"), F.xxhash64(whole()).alias("_text"),
        F.array_distinct(F.transform(_lines(whole()), lambda x: F.xxhash64(_normal(x)))).alias("_hashes"),
    )
    # A row without lines still counts as a text of its host: its null line is counted with the others.
    held = rows.select("_host", "_id", "_text", F.explode(F.array_append("_hashes", F.lit(None).cast("long"))).alias("_line"))
    texts = held.groupBy("_host", "_line", "_text").agg(F.min("_id").alias("_id"))
    lines = texts.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_id"))
    lines = written(lines.filter((F.col("_n") > min_texts) | F.col("_line").isNull()), "host-lines")
    hosts = lines.filter(F.col("_line").isNull()).select(F.col("_host").alias("_h"), F.col("_n").alias("_texts"))
    above = lines.filter(F.col("_line").isNotNull()).join(hosts, F.col("_host").eqNullSafe(F.col("_h")))
    above = above.filter(F.col("_n") > share * F.col("_texts"))
    packed = above.groupBy("_host").agg(F.sort_array(F.collect_list(F.struct("_line", "_id"))).alias("_all"))
    return packed.select(
        F.col("_host").alias("_h"),
        F.col("_all._line").alias("_frequent"),
        F.col("_all._id").alias("_holders"),
    )


def _kept_lines(lines: Column) -> Column:
    """Of an array of lines those that the document keeps, given its host's frequent lines."""

    def stays(line: Column) -> Column:
        at = F.array_position("_frequent", F.xxhash64(_normal(line)))
        return F.coalesce((at == 0) | F.get("_holders", (at - 1).cast("int")).eqNullSafe(F.col("_doc")), F.lit(True))

    return F.filter(lines, stays)


def line_verdicts(docs: DataFrame, *carried: Column, min_texts: int = MIN_TEXTS, share: float = SHARE) -> DataFrame:
    """The carried columns, ``_doc``, ``_text`` and ``_stays``: the lines that each document keeps."""
    names = [f"_c{i}" for i in range(len(carried))]
    host = written(frequent_lines(docs, min_texts, share), "frequent-lines")
    rows = docs.select(
        *[c.alias(n) for c, n in zip(carried, names)], F.col("source").alias("_host"), F.col("doc_id").alias("_doc"),
        whole().alias("_text"),
    )
    joined = rows.join(host, F.col("_host").eqNullSafe(F.col("_h")), "left")
    return joined.withColumn(
        "_stays", F.when(F.col("_frequent").isNotNull(), _kept_lines(F.split("_text", "\n")))
    ).drop("_h", "_host", "_frequent", "_holders")


def quality(docs: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_kept_words, kept.

    One row per row of ``docs``; a null text counts as empty and fails for having no words.  A null doc_id is never the
    first holder of a line unless all holders are null.  Columns other than doc_id, text and source are not read.
    """
    rows = line_verdicts(docs, F.col("text"), min_texts=min_texts, share=share)
    left = F.when(F.col("_stays").isNotNull(), F.regexp_count(F.array_join("_stays", "\n"), F.lit(WORD)).cast("long"))
    rows = rows.select(F.col("_doc").alias("doc_id"), F.col("_c0").alias("text"), left.alias("_left"))
    counted = base_rules(rows, F.col("doc_id"), F.col("_left")).withColumnsRenamed({"_c0": "doc_id", "_c1": "_left"})
    n_kept = F.coalesce("_left", "n_words")
    depleted = (n_kept < LEAST_WORDS) | (n_kept < KEEP_SHARE * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        n_kept.alias("n_kept_words"),
        (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def without_frequent_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE) -> DataFrame:
    """``docs`` with every line above its host's limit taken out of the texts; n_chars, if there, follows."""
    columns = docs.columns
    rows = line_verdicts(docs, *[docs[c] for c in columns], min_texts=min_texts, share=share)
    text = F.when(F.col("_stays").isNotNull(), F.array_join("_stays", "\n")).otherwise(F.col(f"_c{columns.index('text')}"))
    out = {c: F.col(f"_c{i}") for i, c in enumerate(columns)}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_stays").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    out["text"] = text
    return rows.select(*[out[c].alias(c) for c in columns])


def keep_good(docs: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE) -> DataFrame:
    """The documents that pass, with all their columns.  Rows that share an id, or have none, stay if all of them pass.

    The verdicts are written first: a filter on them would else be pushed into the expressions and repeat them.
    """
    verdicts = written(quality(docs, min_texts, share).select("doc_id", "kept"), "quality")
    gone = verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
