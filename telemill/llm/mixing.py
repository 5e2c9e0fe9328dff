"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents lie on a line in the order of a seeded hash of their ids; a prefix sum of their sizes places them.
The mix takes the line from 0 to the source's target, wrapping round up to three times: every copy that ends before the
target.  What is missing up to the target is filled from the documents of the hash range in which the line stopped, each
once more at most: in rounds, the largest that fit, as a prefix sum over falling sizes.  Every round takes the largest
one that fits or more, which at least halves the gap or leaves none that fits; at last the smallest one left is taken
if that brings the source nearer to its target.  The taken stretch is cut into
a quota of equal blocks (by largest share of a fixed number of blocks, one at least).  The tree hands the quotas to the
output shards: each node splits its tickets, one per block, into two halves by rank under a fresh hash, so that the
counts per source on either side are a multivariate-hypergeometric draw, and exact.  Each shard then takes its count of
blocks from the source's permuted blocks, disjoint from all others, and its rows are shuffled locally.

Prefix sums run in two levels (hash ranges of about ``RANGE_ROWS`` documents, then inside them), so that a source with
a third of all rows is spread over many tasks.  Tables per source and per block are small by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.shared import n_words, whole, written

REPEATS = 3
TREE_DEPTH = 4
BLOCKS_PER_SHARD = 64
RANGE_ROWS = 4096
FILL_ROUNDS = 8
SEED = "mix-1"


def _key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *parts))


def source_targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Per source: _no (its rank), source, n_docs, source_size, weight, target.

    Weights are 1, 2, 3, repeating, by code point, null last.  Targets share the total by weight; one that would pass
    ``repeats`` times its source stops there, and the rest is shared again.  Sorted by the level at which they stop,
    the sources that stop are a prefix, so two window sums replace the repeated sharing.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("_no", F.row_number().over(by_name)).withColumn("weight", ((F.col("_no") - 1) % 3 + 1).cast("long"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cap = big("source_size") * repeats
    by_stop = every.orderBy(F.col("source_size") * repeats / F.col("weight"), "_no")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("_total"),
        F.coalesce(F.sum(F.col("source_size") * repeats).over(before), F.lit(0)).alias("_stopped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_open"),
    )
    stops = (big("_total") - big("_stopped")) * F.col("weight") > cap * F.col("_open")
    level = level.withColumn("_stops", stops)
    rest = level.select(
        "*",
        (F.col("_total") - F.sum(F.when(F.col("_stops"), F.col("source_size") * repeats).otherwise(0)).over(every)).alias("_rest"),
        F.sum(F.when(F.col("_stops"), 0).otherwise(F.col("weight"))).over(every).alias("_weights"),
    )
    target = F.when(F.col("_stops"), (F.col("source_size") * repeats).cast("double")).otherwise(
        (F.col("weight") * F.col("_rest")).cast("double") / F.col("_weights").cast("double")
    )
    return rest.select("_no", "source", "n_docs", "source_size", "weight", target.alias("target"), "_total")


def block_shards(sources: DataFrame, depth: int = TREE_DEPTH, per_shard: int = BLOCKS_PER_SHARD) -> DataFrame:
    """Per source with a target: _no, _quota and _shards, the output shard of each of its blocks."""
    blocks = per_shard << depth
    quota = F.greatest(F.lit(1), F.round(F.col("target") * blocks / F.col("_total"))).cast("int")
    tickets = (
        sources.filter("target > 0")
        .select("_no", quota.alias("_quota"))
        .select("_no", "_quota", F.explode(F.sequence(F.lit(0), F.col("_quota") - 1)).alias("_at"))
        .withColumn("_node", F.lit(0))
    )
    for level in range(depth):
        node = Window.partitionBy("_node")
        rank = F.row_number().over(node.orderBy(_key(F.lit(f"split{level}"), "_no", "_at"), "_no", "_at"))
        half = F.floor((F.count(F.lit(1)).over(node) + 1) / 2)
        tickets = tickets.withColumn("_right", (rank > half).cast("int")).select(
            "_no", "_quota", "_at", (F.col("_node") * 2 + F.col("_right")).alias("_node")
        )
    own = Window.partitionBy("_no")
    drawn = tickets.select("_no", F.col("_node").alias("_shard"), F.row_number().over(own.orderBy("_node", "_at")).alias("_rank"))
    permuted = tickets.select(
        "_no", "_quota", "_at", F.row_number().over(own.orderBy(_key(F.lit("block"), "_no", "_at"), "_at")).alias("_rank")
    )
    placed = permuted.join(drawn, ["_no", "_rank"])
    return placed.groupBy("_no", "_quota").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_shard"))).alias("_all")
    ).select("_no", "_quota", F.col("_all._shard").alias("_shards"))


def mix(docs: DataFrame, depth: int = TREE_DEPTH, per_shard: int = BLOCKS_PER_SHARD) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per row of ``docs``.

    ``copies`` lists (pass, block, shard) of each time the mix takes the document, three times at most.  A document
    without words is never taken.  Rows that repeat an id are separate documents at neighbouring places.  Null sources
    are one source, ranked last; a null id takes part under the empty key.  The same rows give the same mix.
    """
    sizes = written(docs.select("doc_id", "source", n_words(whole()).alias("size")), "mix-sizes")
    targets = written(source_targets(sizes), "mix-targets")
    shards = written(block_shards(targets, depth, per_shard), "mix-shards")
    named = targets.join(shards.drop("_shards"), "_no", "left").withColumnsRenamed({"source": "_source"})
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_key", _key(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    )
    ranges = F.ceil(F.col("n_docs") / RANGE_ROWS)
    share = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_range", F.floor(share * ranges / F.lit(1 << 32)).cast("long"))
    per_range = rows.groupBy("_no", "_range").agg(F.sum("size").alias("_sum"))
    until = Window.partitionBy("_no").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.select("_no", "_range", F.coalesce(F.sum("_sum").over(until), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_no", "_range").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(per_range, ["_no", "_range"])
    placed = filled(placed.withColumn("_at", F.col("_base") + F.col("_inner")))
    start = lambda p: F.col("source_size") * p + F.col("_at")
    block = lambda p: F.least(F.floor(start(p) * F.col("_quota") / F.col("target")).cast("int"), F.col("_quota") - 1)
    placed = placed.join(shards.select("_no", "_shards"), "_no", "left")
    passes = F.filter(F.sequence(F.lit(0), F.lit(REPEATS - 1)), lambda p: p < F.col("_copies"))
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("_copies")).cast("long").alias("taken"),
        F.transform(
            passes, lambda p: F.struct(p.alias("pass"), block(p).alias("block"), F.get("_shards", block(p)).alias("shard"))
        ).alias("copies"),
    )


def filled(placed: DataFrame, rounds: int = FILL_ROUNDS) -> DataFrame:
    """Rows of the line (_no, _range, _key, _at, size, source_size, target) with ``_copies``, how often each is taken.

    The copy that crosses the target tells its hash range the gap; in all other ranges the gap is 0 and nothing changes.
    All sums run inside a hash range, on the partitioning the rows have.
    """
    part = Window.partitionBy("_no", "_range")
    falling = part.orderBy(F.desc("size"), "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = lambda p: F.col("source_size") * p + F.col("_at")
    whole_copies = sum(((start(p) + F.col("size")) <= F.col("target")).cast("int") for p in range(REPEATS))
    rows = placed.withColumn("_copies", F.when(F.col("size") > 0, whole_copies).otherwise(0))
    rows = rows.withColumn("_open", (F.col("size") > 0) & (F.col("_copies") < REPEATS))
    crossing = F.when(F.col("_open") & (start(F.col("_copies")) < F.col("target")), F.col("target") - start(F.col("_copies")))
    rows = rows.withColumn("_gap", F.coalesce(F.max(crossing).over(part), F.lit(0.0)))
    for _ in range(rounds):
        rows = rows.withColumn("_fits", F.col("_open") & (F.col("size") <= F.col("_gap")))
        upto = F.sum(F.when(F.col("_fits"), F.col("size"))).over(falling)
        rows = rows.withColumn("_takes", F.col("_fits") & (upto <= F.col("_gap")))
        rows = rows.withColumns({
            "_gap": F.col("_gap") - F.coalesce(F.sum(F.when(F.col("_takes"), F.col("size"))).over(part), F.lit(0)),
            "_open": F.col("_open") & ~F.col("_takes"),
            "_copies": F.col("_copies") + F.col("_takes").cast("int"),
        })
    is_open = F.when(F.col("_open"), 1)
    smallest = F.col("_open") & (F.count(is_open).over(falling) == F.count(is_open).over(part))
    nearer = smallest & (F.col("size") <= 2 * F.col("_gap"))
    return rows.withColumn("_copies", F.col("_copies") + nearer.cast("int")).drop("_open", "_gap", "_fits", "_takes")


def mixed(docs: DataFrame, depth: int = TREE_DEPTH, per_shard: int = BLOCKS_PER_SHARD) -> DataFrame:
    """The rows of the mix: every taken copy with all columns of ``docs``, by shard and in shuffled order inside it.

    Ids are taken to be unique, as documents are; a null id is not matched and leaves the mix.
    """
    copies = mix(docs, depth, per_shard).filter("taken > 0").select(
        F.col("doc_id").alias("_id"), F.explode("copies").alias("_copy")
    )
    columns = docs.columns
    held = docs.toDF(*[f"_c{i}" for i in range(len(columns))])  # whatever the names, none clashes
    rows = held.join(copies, F.col(f"_c{columns.index('doc_id')}") == F.col("_id"))
    rows = rows.withColumn("_order", _key(F.lit("row"), "_id", F.col("_copy.pass")))
    shuffled = rows.repartitionByRange(F.col("_copy.shard"), F.col("_order")).sortWithinPartitions("_copy.shard", "_order")
    return shuffled.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])
