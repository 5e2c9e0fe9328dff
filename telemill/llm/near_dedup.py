"""Near duplicates: MinHash bands, odd sketches, exact confirmation, components.

A document's set is its distinct five-word shingles, A-Z lower-cased, as 64-bit hashes.  ``HASHES`` MinHash samples of
the set give ``BANDS`` band keys; bands of four samples miss a pair at similarity 0.75 once in 190,000 pairs.  Samples of
``BINS`` bins under one permutation are folded into an odd sketch: a bitmap in which every sample flips one bit.  The
ones in the XOR of two sketches estimate how many samples differ; candidates with more ones than a pair at the threshold
shows, plus ``DEVIATIONS`` standard deviations of sampling and folding, are passed over.  Links are confirmed on full sets.

Rows with equal sets are one class from the start, however many they are.  In a bucket of equal band keys the member
that shares most buckets with others is compared with all others.  Buckets that then still hold several components are
looked at once more: pairs of members of different components are held against each other by their sketches, in
the first bucket that they share, and the likely ones are confirmed.  So a group of near copies costs a number of
confirmed pairs in proportion to its size, and no candidate between different components is left out.  A bucket with
more than ``BLOCK`` members is spread over pairs of blocks.

Components come from contraction: every node joins the neighbour of smallest hashed rank, joined edges vanish, until no
edge is left.  All tables are joined and aggregated by Spark; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import whole, written

WORDS = 5
PERCENT = 75
HASHES, BANDS = 128, 32
BINS, SKETCH_BITS, DEVIATIONS = 2048, 4096, 4.5
BLOCK = 2048
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _constants(n: int, seed: int) -> np.ndarray:
    return _mixed((np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_BASE = int(_constants(1, 1)[0])
_STEPS = _constants(WORDS, 2)
_FAMILY = _constants(HASHES, 3)
_BAND = _constants(HASHES // BANDS, 4)
_SALT = _constants(2, 5)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; with fewer words, of the whole sequence; none without words."""
    raw = text.encode().translate(_LOWER)
    words = raw.split()  # at 20 and 09 to 0D
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    data = np.frombuffer(b"".join(words), np.uint8).astype(_U) + _U(1)
    sizes = np.fromiter(map(len, words), np.int64, n)
    begins = np.cumsum(sizes) - sizes
    powers = np.full(int(sizes.max()), _BASE, _U)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(data)) - np.repeat(begins, sizes)
    hashed = _mixed(np.add.reduceat(data * powers[place], begins))
    if n < WORDS:
        return _mixed(np.array([sum(int(h) * int(s) for h, s in zip(hashed, _STEPS)) + n & (1 << 64) - 1], _U))
    joined = sum(hashed[i : n - WORDS + 1 + i] * _STEPS[i] for i in range(WORDS))
    return np.unique(_mixed(joined))


def samples(hashes: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that is not empty."""
    low = np.full(HASHES, np.iinfo(_U).max, _U)
    for at in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[at : at + 1024, None] * _FAMILY).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, -1)
    return _mixed((_mixed(rows) * _BAND).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U)).view(np.int64)


def bin_samples(hashes: np.ndarray) -> np.ndarray:
    """The least of the sorted hashes in each bin that has any."""
    bins = (_mixed(hashes ^ _SALT[0]) % _U(BINS)).astype(np.uint16)
    order = np.argsort(bins, kind="stable")
    return hashes[order[np.append(True, bins[order][1:] != bins[order][:-1])]]


def odd_sketch(low: np.ndarray) -> bytes:
    flips = np.bincount((_mixed(low ^ _SALT[1]) % _U(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def most_ones(na: np.ndarray, nb: np.ndarray, ka: np.ndarray, kb: np.ndarray, deviations: float = DEVIATIONS) -> np.ndarray:
    """Ones in the XOR of the sketches that a pair at the threshold may show, from the sizes of sets and samples."""
    similarity = PERCENT / 100
    union = (na + nb) / (1 + similarity)
    filled = BINS * -np.expm1(-union / BINS)
    spread = np.sqrt(filled * similarity * (1 - similarity) * np.maximum(0, 1 - filled / union))
    differ = np.maximum(0, ka + kb - 2 * similarity * filled) + 2 * deviations * spread
    ones = SKETCH_BITS / 2 * -np.expm1(-2 * differ / SKETCH_BITS)
    folded = SKETCH_BITS / 4 * -np.expm1(-4 * differ / SKETCH_BITS) - differ * np.exp(-4 * differ / SKETCH_BITS)
    return ones + deviations * np.sqrt(np.maximum(folded, 0)) + 1


def _likely(one: dict[str, np.ndarray], other: dict[str, np.ndarray]) -> np.ndarray:
    """Whether set sizes and sketches (n, k, sketch as rows of words) allow a link; shapes are broadcast."""
    na, nb = one["n"], other["n"]
    ones = np.bitwise_count(one["sketch"] ^ other["sketch"]).sum(axis=-1, dtype=np.int64)
    return (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)) & (ones <= most_ones(na, nb, one["k"], other["k"]))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, _digest (of the set), _k (samples in the sketch), _sketch, _keys (bands); sets may be empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        none = np.zeros(0, np.int64)
        for batch in batches:
            sizes, digests, counts, sketches, keys = [], [], [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py() or "")
                low = bin_samples(own) if len(own) else own
                sizes.append(len(own))
                digests.append(hashlib.md5(own.tobytes()).digest())
                counts.append(len(low))
                sketches.append(odd_sketch(low))
                keys.append(band_keys(samples(own)) if len(own) else none)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()),
                 pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "_digest", "_k", "_sketch", "_keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles long, _digest binary, _k long, _sketch binary, _keys array<long>"
    )


def _side(batch: pa.RecordBatch, end: str = "") -> dict[str, np.ndarray]:
    words = np.frombuffer(b"".join(batch.column(f"_sketch{end}").to_pylist()), _U).reshape(batch.num_rows, -1)
    return {"n": batch.column(f"_n{end}").to_numpy(), "k": batch.column(f"_k{end}").to_numpy(), "sketch": words}


def _with_sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs (_a, _b) with columns of both ends."""
    for end in "ba":
        side = table.select(F.col("_rep").alias(f"_{end}"), *[F.col(c).alias(f"{c}{end}") for c in columns])
        pairs = pairs.join(side, f"_{end}")
    return pairs.select("_a", "_b", *[f"{c}{end}" for end in "ab" for c in columns])


def _sketched(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (_a, _b) whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["_a", "_b"]).filter(pa.array(_likely(_side(batch, "a"), _side(batch, "b"))))

    return _with_sides(pairs, reps, "_n", "_k", "_sketch").mapInArrow(run, "_a long, _b long")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (_a, _b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            keep = []
            for i, a in enumerate(batch.column("_a").to_pylist()):
                if a != last:  # rows of one centre arrive together
                    last, left = a, shingles(batch.column("_texta")[i].as_py())
                right = shingles(batch.column("_textb")[i].as_py())
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(left) + len(right) - common))
            yield batch.select(["_a", "_b"]).filter(pa.array(keep, pa.bool_()))

    return written(_with_sides(written(pairs, "pairs"), texts, "_text").mapInArrow(run, "_a long, _b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """_rep, _comp (the smallest id reachable) of every id that has a link."""
    edges = written(links.select("_a", "_b").filter("_a <> _b").distinct(), "edges")
    nodes = edges.select(F.col("_a").alias("_rep")).union(edges.select(F.col("_b").alias("_rep"))).distinct()
    labels = nodes.select("_rep", F.col("_rep").alias("_root"))
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("id"))
        both = edges.select("_a", "_b").union(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = both.groupBy("_a").agg(F.min(rank("_b")).alias("_low"))
        joins = least.select(F.col("_a").alias("_node"), F.least("_low", rank("_a"))["id"].alias("_to"))
        joins = written(joins, "joins")
        moved = F.coalesce("_to", "_root").alias("_root")
        labels = written(labels.join(joins, F.col("_root") == F.col("_node"), "left").select("_rep", moved), "labels")
        for end in ("_a", "_b"):
            edges = edges.join(joins, F.col(end) == F.col("_node")).drop("_node", end).withColumnRenamed("_to", end)
        edges = written(edges.filter("_a <> _b").select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct(), "edges")
    smallest = labels.groupBy("_root").agg(F.min("_rep").alias("_comp"))
    return written(labels.join(smallest, "_root").select("_rep", "_comp"), "components")


def _pairs_in_block(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of a bucket (or of two of its blocks) the likely pairs of different components, as indexes."""
    comp, block, keys, n = rows["comp"], rows["block"], rows["keys"], len(rows["comp"])
    names, sizes = np.unique(comp, return_counts=True)
    main = comp == names[sizes.argmax()]
    every, lefts, rights = np.arange(n), [], []
    across = block.min() != block.max() or rows["across"]
    step = max(1, (1 << 17) // n)
    rest = np.flatnonzero(~main)
    for at in range(0, len(rest), step):
        own = rest[at : at + step]
        meets = (comp[own][:, None] != comp) & (main | (every > own[:, None]))
        if across:
            meets &= block[own][:, None] != block
        left, right = np.nonzero(meets)
        left = own[left]
        pick = lambda i: {c: rows[c][i] for c in ("n", "k", "sketch")}
        near = _likely(pick(left), pick(right))
        left, right = left[near], right[near]
        first = (keys[left] == keys[right]).argmax(axis=1) == rows["band"]
        lefts.append(left[first])
        rights.append(right[first])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *lefts]), np.concatenate([none, *rights])


def _across_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_a, _b of likely pairs, from rows sorted by bucket and pair of blocks; each pair in its first common bucket."""
    held: list[pa.RecordBatch] = []

    def pairs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        plain = {c: rows.column(f"_{c}").to_numpy() for c in ("key", "i", "j", "band", "rep", "comp", "block")}
        side = _side(rows)
        keys = rows.column("_keys").flatten().to_numpy().reshape(rows.num_rows, -1)
        fresh = np.append(True, (plain["key"][1:] != plain["key"][:-1]) | (plain["i"][1:] != plain["i"][:-1]) | (plain["j"][1:] != plain["j"][:-1]))
        bounds = np.append(np.flatnonzero(fresh), rows.num_rows)
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = slice(begin, end)
            group = {"keys": keys[own], "band": plain["band"][begin], "comp": plain["comp"][own], "block": plain["block"][own]}
            group |= {c: side[c][own] for c in side} | {"across": plain["i"][begin] != plain["j"][begin]}
            left, right = _pairs_in_block(group)
            if len(left):
                one, other = plain["rep"][own][left], plain["rep"][own][right]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], ["_a", "_b"])

    def last_group(rows: pa.RecordBatch) -> int:
        """Where the last bucket, which may go on, begins."""
        same = np.ones(rows.num_rows, bool)
        for c in ("_key", "_i", "_j"):
            same &= rows.column(c).to_numpy() == rows.column(c)[-1].as_py()
        return int(rows.num_rows - same.sum())

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]
        cut = last_group(rows)
        yield from pairs(rows.slice(0, cut))
        held = [rows.slice(cut)]
    if held:
        yield from pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _unsettled(members: DataFrame, comps: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components, once for each pair of blocks that they are in."""
    placed = members.filter("_size > 2").select("_key", "_band", "_rep", "_size").join(comps, "_rep", "left")
    placed = placed.withColumn("_comp", F.coalesce("_comp", "_rep"))
    several = placed.groupBy("_key").agg(F.min("_comp").alias("_low"), F.max("_comp").alias("_high")).filter("_low <> _high")
    blocks = F.ceil(F.col("_size") / BLOCK).cast("int")
    rows = placed.join(several.select("_key"), "_key").withColumn("_block", F.pmod(F.xxhash64("_rep"), blocks).cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(
        "_key", "_band", "_rep", "_comp", "_block", F.least("_block", "_with").alias("_i"), F.greatest("_block", "_with").alias("_j")
    )
    return rows.join(reps, "_rep")


def link_components(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """_rep, _comp of the linked among ``reps`` (_rep, _n, _k, _sketch, _keys), whose texts are in ``docs``."""
    rows = reps.select("_rep", F.posexplode("_keys").alias("_band", "_key"))
    buckets = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    members = written(rows.join(buckets, "_key"), "members")
    # The centre of a bucket: the member with most company in all its buckets, of equals the smallest id.
    company = members.groupBy("_rep").agg(F.sum("_size").alias("_company"))
    ranked = members.join(company, "_rep")
    centres = ranked.groupBy("_key").agg(F.max(F.struct("_company", -F.col("_rep"))).alias("_top"))
    centres = centres.select("_key", (-F.col("_top.col2")).alias("_centre"))
    met = members.select("_key", "_rep").join(centres, "_key").filter("_rep <> _centre")
    pairs = met.select(F.col("_centre").alias("_a"), F.col("_rep").alias("_b")).distinct()
    # Texts of all members, as any of them may be compared later on.
    wanted = members.select(F.col("_rep")).distinct().hint("merge")
    texts = written(docs.select(F.col("doc_id").alias("_rep"), whole().alias("_text")).join(wanted, "_rep"), "member-texts")
    links = _linked(_sketched(pairs, reps), texts)
    comps = components(links)
    unsettled = _unsettled(members, comps, reps).repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j")
    found = _linked(unsettled.mapInArrow(_across_components, "_a long, _b long"), texts)
    return components(links.union(found))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    A null or empty text, or one without words, has no shingles and stands alone.  Ids are taken to be unique; rows that
    repeat one share its verdict if their texts are equal.  A null id is linked to rows with an equal set only.  Other
    columns are not read.
    """
    rows = written(signatures(docs), "signatures")
    full = rows.filter("n_shingles > 0")
    classes = full.groupBy("_digest").agg(F.min("doc_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"))
    classes = written(classes.filter(F.col("_rep").isNotNull()), "classes")
    first = classes.select("_digest", "_rep")
    reps = full.join(first, (full["_digest"] == first["_digest"]) & (F.col("doc_id") == F.col("_rep")), "left_semi")
    reps = reps.dropDuplicates(["doc_id", "_digest"]).select(F.col("doc_id").alias("_rep"), F.col("n_shingles").alias("_n"), "_k", "_sketch", "_keys")
    reps = written(reps, "reps")
    comps = link_components(reps, docs)
    joined = classes.join(comps, "_rep", "left")
    joined = joined.filter("_copies > 1 OR _comp IS NOT NULL").select(
        F.col("_digest").alias("_of"), F.coalesce("_comp", "_rep").alias("_component")
    )
    joined = written(joined, "groups")
    out = rows.select("doc_id", "n_shingles", "_digest").join(
        joined, (F.col("_digest") == F.col("_of")) & (F.col("n_shingles") > 0), "left"
    )
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the smallest id.  Rows that share an id, or have none, go together."""
    gone = near_groups(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
