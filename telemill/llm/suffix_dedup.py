"""Repeated byte strings: suffix arrays by induced sorting over shards of anchored segments.

Every string of ``LENGTH`` bytes has an anchor, its ``GRAM``-byte gram of least hash (the leftmost of equals).  Strings
at neighbouring places that share an anchor form a segment, at most 177 bytes.  Equal strings have equal anchors at equal
places, so only segments with equal grams need to meet: texts are not shuffled to find repeats, only one row per segment
with the hashes of its gram and its bytes.

1. Segments are dealt and sorted by (gram, bytes, document, place).  Equal segments form a class: all but the first
   are removed whole.  Repeats inside one slice of the input are settled before the shuffle, so a passage in a third
   of all documents sends one row per slice.  Grams with one class are done.
2. Classes of grams with several send the bytes of their first segments to a shard of that gram.  A shard's suffix
   array is built by induced sorting: suffixes are typed, leftmost smaller-type substrings are sorted and named, the
   order of the shortened text is found recursively, and all suffixes are induced from it.  Permuted common prefixes
   of neighbours then tell strings that occur more than once; all but the earliest are removed.
3. A gram with more than ``HOT_CLASSES`` classes would overfill a shard: its strings are compared one by one through
   an aggregation by their hashes instead.
4. The removed stretches go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import written

LENGTH = 100
GRAM = 24
#: Bytes of texts that a worker looks at together, and bytes of segments in one suffix array.
SLICE_BYTES = 1 << 19
SHARD_BYTES = 1 << 19
HOT_CLASSES = 20_000
_U = np.uint64
_NO_ID = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_ODD = _mixed(np.arange(1, 40, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_BYTE = _mixed(np.arange(256, dtype=_U) + _U(1 << 40))
_OTHER = _mixed(np.arange(256, dtype=_U) + _U(1 << 41))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BASE = int(_ODD[30])
_TABLES: list[np.ndarray] = [_powers(1, 0), _powers(1, 0)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_TABLES[0]) < n:
        _TABLES[:] = [_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)]
    return _TABLES


def range_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A hash of the symbols in each range, the same wherever the range stands."""
    up, down = _tables(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(table[raw] * up[: len(raw)], dtype=_U)])
    return _mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(_U))


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """The hash of the gram at every place; sizes are doubled and joined."""
    have, level, done, at = _BYTE[raw], 0, None, 0
    width = 1
    while True:
        if size & width:
            if done is None:
                done, at = have, width
            else:
                done = done[: len(raw) - at - width + 1] * _ODD[10 + level] + have[at : at + len(raw) - at - width + 1]
                at += width
        if 2 * width > size:
            return _mixed(done)
        have = have[:-width] * _ODD[level] + have[width:]
        width, level = 2 * width, level + 1


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        values, step = np.minimum(values[:-step], values[step:]), 2 * step
    return np.minimum(values[: len(values) - (width - step)], values[width - step :]) if step < width else values


def segments(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the adjoining texts [begin, end): for each segment its text, first place, number of strings, gram and class.

    The class holds 57 bits of the hash of the bytes and, in the last 7, the number of strings.
    """
    if len(raw) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, _U) for _ in range(2))
    grams = gram_hashes(raw)
    bits = _U(max(1, int(len(grams)).bit_length()))
    ranked = (grams >> bits << bits) | np.arange(len(grams), dtype=_U)
    anchors = (_sliding_least(ranked, LENGTH - GRAM + 1) & ((_U(1) << bits) - _U(1))).astype(np.int64)
    text = np.repeat(np.arange(len(begins)), ends - begins)[: len(anchors)]
    valid = np.arange(len(anchors)) + LENGTH <= ends[text]
    fresh = np.ones(len(anchors), bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh & valid)
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, _U) for _ in range(2))
    last = np.minimum(np.append(first[1:], len(anchors)), ends[text[first]] - LENGTH + 1)
    n = last - first
    classes = range_hashes(raw, first, last + LENGTH - 1)
    return text[first], first, n, grams[anchors[first]], (classes & ~_U(127)) | n.astype(_U)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def _pieces(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(id, row, offset, bytes) in lists of about ``SLICE_BYTES``; long texts in pieces that share LENGTH - 1 bytes."""
    held, size = [], 0
    for doc, row, text in zip(batch.column("_id").to_pylist(), batch.column("_row").to_pylist(), _texts(batch)):
        for at in range(0, max(1, len(text) - LENGTH + 1), SLICE_BYTES):
            piece = text[at : at + SLICE_BYTES + LENGTH - 1]
            held.append((doc, row, at, piece))
            size += len(piece)
            if size >= SLICE_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_gram, _class, _doc, _row, _start of every segment; one that repeats in its slice has -1 - start and only its size."""
    for batch in batches:
        for pieces in _pieces(batch):
            raw = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
            ends = np.cumsum([len(p[3]) for p in pieces])
            begins = np.append(0, ends[:-1])
            text, first, n, gram, kind = segments(raw, begins, ends)
            doc, row, offset = (np.array([p[k] for p in pieces], np.int64)[text] for k in range(3))
            start = first - begins[text] + offset
            order = np.lexsort((start, row, doc, kind, gram))
            n, gram, kind, doc, row, start = (x[order] for x in (n, gram, kind, doc, row, start))
            again = np.zeros(len(order), bool)
            again[1:] = (gram[1:] == gram[:-1]) & (kind[1:] == kind[:-1])
            gram = np.where(again, _mixed(doc.view(_U) * _ODD[20] + row.view(_U) + start.view(_U)), gram)
            kind = np.where(again, n.astype(_U), kind)
            start = np.where(again, -1 - start, start)
            yield pa.RecordBatch.from_arrays(
                [_signed(gram), _signed(kind), pa.array(doc), pa.array(row), pa.array(start)], ["_gram", "_class", "_doc", "_row", "_start"]
            )


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted segments: removed ones (_gram null), and first segments of grams with several classes.

    Only the last class and the last first segment are carried from batch to batch.
    """
    names = ["_gram", "_doc", "_row", "_start", "_n"]
    before = None  # gram and class of the last row
    waiting = None  # (gram, doc, row, start, n, contested) of the last first segment

    def rows(gram, doc, row, start, n, keep_gram):
        grams = pa.array(gram, pa.int64()) if keep_gram else pa.nulls(len(doc), pa.int64())
        return pa.RecordBatch.from_arrays([grams, *(pa.array(x, pa.int64()) for x in (doc, row, start, n))], names)

    for batch in batches:
        gram, kind, doc, row, start = (batch.column(c).to_numpy() for c in ("_gram", "_class", "_doc", "_row", "_start"))
        if not len(gram):
            continue
        local = start < 0
        n = kind & 127
        if local.any():
            yield rows(None, doc[local], row[local], -1 - start[local], n[local], False)
            gram, kind, doc, row, start, n = (x[~local] for x in (gram, kind, doc, row, start, n))
            if not len(gram):
                continue
        same = np.zeros(len(gram), bool)
        same[1:] = (gram[1:] == gram[:-1]) & (kind[1:] == kind[:-1])
        same[0] = before == (gram[0], kind[0])
        before = (gram[-1], kind[-1])
        if same.any():
            yield rows(None, doc[same], row[same], start[same], n[same], False)
        first = [x[~same] for x in (gram, doc, row, start, n)]
        if not len(first[0]):
            continue
        contested = np.zeros(len(first[0]), bool)
        contested[1:] = first[0][1:] == first[0][:-1]
        contested[0] = waiting is not None and waiting[0] == first[0][0]
        if waiting is not None and (waiting[5] or contested[0]):
            yield rows(*([x] for x in waiting[:5]), True)
        waiting = (*(x[-1] for x in first), bool(contested[-1]))
        contested[:-1] |= contested[1:]
        contested[-1] = False
        if contested.any():
            yield rows(*(x[contested] for x in first), True)
    if waiting is not None and waiting[5]:
        yield rows(*([x] for x in waiting[:5]), True)


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is not."""
    change = np.flatnonzero(text[:-1] != text[1:])
    rises = np.append(text[change] < text[change + 1], False)
    return rises[np.searchsorted(change, np.arange(len(text)))]


def _induce_by_bucket(text: np.ndarray, symbols: int, small: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the ordered leftmost small ones; a bucket's suffixes move together."""
    n = len(text)
    large: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    lower: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    code = text.astype(np.uint16)
    seeds = np.split(ordered[np.argsort(code[ordered], kind="stable")], np.cumsum(np.bincount(code[ordered], minlength=symbols))[:-1])

    def deal(places: np.ndarray, to: list[list[np.ndarray]]) -> None:
        own = code[places]
        order = np.argsort(own, kind="stable")
        places, own = places[order], own[order]
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        for part in np.split(places, cuts) if len(places) else ():
            to[code[part[0]]].append(part)

    def scan(c: int, start: list[np.ndarray], kind: bool, to: list[list[np.ndarray]]) -> np.ndarray:
        """A bucket's suffixes of one kind, in the order of the scan; the bucket may feed itself."""
        found, current = [], np.concatenate(start) if start else np.zeros(0, np.int64)
        while len(current):
            found.append(current)
            before = current[current > 0] - 1
            before = before[small[before] == kind]
            inside = code[before] == c
            deal(before[~inside], to)
            current = before[inside]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    large[code[n - 1]].append(np.array([n - 1]))
    rows = []
    for c in range(symbols):
        rows.append(scan(c, large[c], False, large))
        deal(seeds[c][seeds[c] > 0] - 1, large)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * symbols
    for c in range(symbols - 1, -1, -1):
        own = scan(c, lower[c], True, lower)
        back = rows[c][::-1]
        back = back[back > 0] - 1
        deal(back[small[back]], lower)
        out[c] = np.concatenate([rows[c], own[::-1]])
    return np.concatenate(out)


def _induce_one_by_one(text: np.ndarray, symbols: int, small: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The same for texts with many symbols, whose buckets are too small to move as arrays."""
    n, letters, kinds = len(text), text.tolist(), small.tolist()
    counts = np.bincount(text, minlength=symbols)
    heads = (np.cumsum(counts) - counts).tolist()
    ends = np.cumsum(counts)
    out = [-1] * n
    tails = ends.tolist()
    for at in reversed(ordered.tolist()):
        tails[letters[at]] -= 1
        out[tails[letters[at]]] = at
    c = letters[n - 1]
    out[heads[c]] = n - 1
    heads[c] += 1
    for i in range(n):
        at = out[i] - 1
        if at >= 0 and not kinds[at]:
            c = letters[at]
            out[heads[c]] = at
            heads[c] += 1
    tails = ends.tolist()
    for i in range(n - 1, -1, -1):
        at = out[i] - 1
        if at >= 0 and kinds[at]:
            c = letters[at]
            tails[c] -= 1
            out[tails[c]] = at
    return np.array(out, np.int64)


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """The order of all suffixes of a text of symbols 0 to symbols - 1, by induced sorting."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    induce = _induce_by_bucket if n > 64 * symbols and symbols < 1 << 16 else _induce_one_by_one
    small = _types(text)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(left) < 2:
        return induce(text, symbols, small, left)
    order = induce(text, symbols, small, left)  # sorts the substrings between them
    marked = np.zeros(n, bool)
    marked[left] = True
    order = order[marked[order]]
    ends = np.append(left[1:] + 1, n)
    place = np.empty(n, np.int64)
    place[left] = np.arange(len(left))
    # A substring is equal to the one before it if its symbols are; the last one ends in nothing and equals none.
    letters = _mixed(np.arange(symbols, dtype=_U) + _U(1 << 42))
    hashes = range_hashes(text, left, ends, letters)[place[order]]
    differs = np.append(True, hashes[1:] != hashes[:-1])
    last = int(np.flatnonzero(order == left[-1])[0])
    differs[last] = True
    differs[last + 1 : last + 2] = True
    names = np.cumsum(differs) - 1
    if names[-1] + 1 < len(left):
        short = np.empty(len(left), np.int64)
        short[place[order]] = names
        order = left[suffix_array(short, int(names[-1]) + 1)]
    return induce(text, symbols, small, order)


def common_prefixes(text: np.ndarray, order: np.ndarray, symbols: int, most: int = 127) -> np.ndarray:
    """Permuted common prefixes: by place, what a suffix shares with the one before it in order, up to ``most``.

    Hashes of doubled lengths are compared from the longest on.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(most + 1, text.dtype)])
    inside = np.concatenate([np.ones(n, bool), np.zeros(most + 1, bool)])
    levels = [_mixed(padded.astype(_U) + _U(symbols + 1))]
    levels[0][~inside] = _mixed(np.arange(most + 1, dtype=_U) + _U(1 << 50))  # beyond the end nothing is equal
    width = 1
    while 2 * width <= most:
        levels.append(levels[-1][:-width] * _ODD[len(levels)] + levels[-1][width:])
        width *= 2
    shared = np.zeros(n, np.int64)
    one, other = order[1:], order[:-1]
    found = np.zeros(len(one), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = one + found, other + found
        top = len(levels[level]) - 1
        equal = (levels[level][np.minimum(a, top)] == levels[level][np.minimum(b, top)]) & (a <= top) & (b <= top)
        found += equal << level
    shared[one] = found
    return shared


def repeated_strings(parts: list[bytes], docs: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of first segments, (part, offset) of each string that also occurs at an earlier (document, row, place)."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1)
    text[ends - 1] = 0
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    offset = np.arange(len(text)) - (ends - sizes - 1)[owner]
    order = suffix_array(text, 257)
    whole = offset + LENGTH <= sizes[owner]
    shared = common_prefixes(text, order, 257)
    # No shorter suffix stands between two equal strings, so neighbours suffice.
    order = order[whole[order]]
    group = np.cumsum(np.append(True, shared[order[1:]] < LENGTH)) if len(order) else order
    part, at = owner[order], offset[order]
    rank = np.lexsort((starts[part] + at, rows[part], docs[part], group))
    later = np.zeros(len(rank), bool)
    later[1:] = group[rank][1:] == group[rank][:-1]
    places = rank[later]
    return part[places], at[places]


def _runs(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings at neighbouring offsets of a part joined: part, first offset, number."""
    order = np.lexsort((at, part))
    part, at = part[order], at[order]
    fresh = np.append(True, (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1))[: len(part)]
    begin = np.flatnonzero(fresh)
    return part[begin], at[begin], np.diff(np.append(begin, len(part)))


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_doc, _row, _start, _n of removed strings; shards hold whole grams, in about ``SHARD_BYTES``."""
    held: list[tuple[int, int, int, int, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        docs, rows, starts = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3))
        part, at, n = _runs(*repeated_strings([h[4] for h in held], docs, rows, starts))
        columns = docs[part], rows[part], starts[part] + at, n
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_doc", "_row", "_start", "_n"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("_gram", "_doc", "_row", "_start", "_bytes"))):
            if size >= SHARD_BYTES and row[0] != held[-1][0]:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield flush()


def distinct_rows(docs: DataFrame) -> DataFrame:
    """_id, _row, text, _times: the documents, each a row of its own.

    ``_id`` is the doc_id, for null the least number.  Ids and null ids that repeat are told apart by a hash of the text
    in ``_row``, which is 0 where ids do not repeat.  Rows that repeat id and text become one with their number.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    if rows.groupBy("_id").count().filter("count > 1").isEmpty():
        return rows.select("_id", F.lit(0).cast("long").alias("_row"), "text", F.lit(1).cast("long").alias("_times"))
    rows = rows.select("_id", F.xxhash64("text").alias("_row"), "text")
    copies = rows.groupBy("_id", "_row").agg(F.count("*").alias("_times")).filter("_times > 1")
    copies = written(copies, "repeated-rows")
    single = rows.join(copies, ["_id", "_row"], "left_anti").withColumn("_times", F.lit(1).cast("long"))
    first = rows.join(copies, ["_id", "_row"], "left_semi").groupBy("_id", "_row").agg(F.min("text").alias("text"))
    return written(single.unionByName(first.join(copies, ["_id", "_row"])), "distinct-rows")


def _packed(rows: DataFrame) -> DataFrame:
    """_id, _row, _times and the compressed text: what is shuffled, twice, is a third of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([squeeze.compress(t) for t in _texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_row", "_times")), packed], ["_id", "_row", "_times", "_packed"])

    return rows.select("_id", "_row", "_times", "text").mapInArrow(run, "_id long, _row long, _times long, _packed binary")


def _same_row() -> Column:
    return (F.col("_id") == F.col("_doc")) & (F.col("_row") == F.col("_of"))


def _bytes_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """_gram, _doc, _row, _start, _bytes of the wanted segments (_gram, _doc, _row, _start, _n)."""
    lists = wanted.groupBy("_doc", F.col("_row").alias("_of")).agg(F.collect_list(F.struct("_gram", "_start", "_n")).alias("_list")).hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            listed = batch.column("_list")
            grams, starts, sizes = listed.flatten().flatten()
            ends = np.cumsum(pc.list_value_length(listed).to_numpy())
            cut: list[bytes] = []
            for packed, end in zip(batch.column("_packed"), ends.tolist()):
                raw, begin = opener.decompress(packed.as_py()), len(cut)
                cut += [raw[s : s + n + LENGTH - 1] for s, n in zip(starts[begin:end].to_pylist(), sizes[begin:end].to_pylist())]
            docs_of, rows_of = (np.repeat(batch.column(c).to_numpy(), np.diff(ends, prepend=0)) for c in ("_id", "_row"))
            for at in range(0, len(cut), 10_000):
                own = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [grams[own], pa.array(docs_of[own]), pa.array(rows_of[own]), starts[own], pa.array(cut[own], pa.binary())],
                    ["_gram", "_doc", "_row", "_start", "_bytes"],
                )

    joined = _packed(rows).join(lists, _same_row()).select("_id", "_row", "_packed", "_list")
    return joined.mapInArrow(run, "_gram long, _doc long, _row long, _start long, _bytes binary")


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes, _doc, _row and _start of every string of segments."""
    for batch in batches:
        parts = batch.column("_bytes").to_pylist()
        raw = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        n = sizes - LENGTH + 1
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(sizes) - sizes, n) + inner
        docs, rows, starts = (batch.column(c).to_numpy() for c in ("_doc", "_row", "_start"))
        hashes = [range_hashes(raw, at, at + LENGTH, t) for t in (_BYTE, _OTHER)]
        places = np.repeat(docs, n), np.repeat(rows, n), np.repeat(starts, n) + inner
        yield pa.RecordBatch.from_arrays([*map(_signed, hashes), *map(pa.array, places)], ["_one", "_two", "_doc", "_row", "_start"])


def removed_stretches(texts: DataFrame) -> DataFrame:
    """_doc, _row, _start, _n of ``distinct_rows``: n strings from ``_start`` on also start earlier."""
    fields = "_doc long, _row long, _start long, "
    rows = texts.select("_id", "_row", "text").mapInArrow(_segment_rows, f"_gram long, _class long, {fields[:-2]}")
    dealt = rows.repartition("_gram").sortWithinPartitions("_gram", "_class", "_doc", "_row", "_start")
    settled = written(dealt.mapInArrow(_settle, f"_gram long, {fields} _n long"), "segments")
    removed = settled.filter(F.col("_gram").isNull()).select("_doc", "_row", "_start", "_n")
    first = settled.filter(F.col("_gram").isNotNull())
    hot = first.groupBy("_gram").agg(F.count(F.lit(1)).alias("_classes")).filter(F.col("_classes") > HOT_CLASSES)
    hot = written(hot.select(F.col("_gram").alias("_hot")), "hot-grams")
    parts = _bytes_of(texts, first)
    if not hot.isEmpty():
        parts = written(parts, "segment-bytes")
        strings = parts.join(hot, F.col("_gram") == F.col("_hot"), "left_semi").mapInArrow(_string_rows, f"_one long, _two long, {fields[:-2]}")
        strings = written(strings, "strings")
        place = F.struct("_doc", "_row", "_start")
        least = strings.groupBy("_one", "_two").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_of"))
        least = written(least.filter("_of > 1"), "first-strings")
        later = strings.join(least, ["_one", "_two"]).filter(place != F.col("_first"))
        removed = removed.union(later.select("_doc", "_row", "_start", F.lit(1).cast("long")))
        parts = parts.join(hot, F.col("_gram") == F.col("_hot"), "left_anti")
    shards = parts.repartition("_gram").sortWithinPartitions("_gram").mapInArrow(_sorted_shards, f"{fields} _n long")
    return removed.union(shards)


def _with_copies(rows: DataFrame, with_text: bool) -> DataFrame:
    """One row per document again: of rows that repeat, all but one lose what 100-byte strings cover."""
    ways = 256
    dealt = rows.filter("_times > 1").withColumn("_way", F.explode(F.sequence(F.lit(1), F.lit(ways))))
    dealt = dealt.filter(F.col("_way") < F.col("_times")).repartition("_way")
    copies = dealt.withColumn("_copy", F.explode(F.sequence(F.col("_way").cast("long"), F.col("_times") - 1, F.lit(ways).cast("long"))))
    covered = F.col("n_bytes") >= LENGTH
    digest = F.when(covered, F.sha2(F.lit(b""), 256)).otherwise(F.col("kept_sha256"))
    columns = {
        "n_removed": F.when(covered, F.col("n_bytes")).otherwise(F.lit(0)).cast("long"),
        "n_spans": covered.cast("long"),
        "kept_sha256": digest,
    }
    if with_text:
        one = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        columns |= {"spans": F.when(covered, one).otherwise(F.col("spans")), "kept": F.when(covered, F.lit(b"")).otherwise(F.col("kept"))}
    return rows.drop("_times").unionByName(copies.withColumns(columns).drop("_times", "_way", "_copy"))


def drop_repeated_strings(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, spans (start and end in bytes) and kept (bytes).

    One row per row of ``docs``.  A null text counts as empty; texts shorter than ``LENGTH`` bytes keep all.  Null ids
    come before all others.  Rows that share an id, or have none, are documents of their own, in the order of a hash of
    their texts; of rows that repeat id and text, one keeps what is first there and the others lose all that a string
    covers.  Ids are numbers.  Other columns are not read.
    """
    texts = distinct_rows(docs)
    stretches = removed_stretches(texts).groupBy("_doc", F.col("_row").alias("_of")).agg(F.collect_list(F.struct("_start", "_n")).alias("_list"))
    joined = _packed(texts).join(stretches.hint("merge"), _same_row(), "left").select("_id", "_times", "_packed", "_list")
    fields = "doc_id long, _times long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    fields += ", spans array<struct<start:long,end:long>>, kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, times, packed, listed in zip(*(batch.column(c) for c in ("_id", "_times", "_packed", "_list"))):
                raw = opener.decompress(packed.as_py())
                begins = ends = np.zeros(0, np.int64)
                if listed.is_valid:
                    start, n = (np.asarray(x) for x in listed.values.flatten())
                    order = np.argsort(start)
                    start = start[order]
                    reach = np.minimum(np.maximum.accumulate(start + n[order] + LENGTH - 1), len(raw))
                    fresh = np.append(True, start[1:] > reach[:-1])
                    begins, ends = start[fresh], np.append(reach[:-1][fresh[1:]], reach[-1])
                    inside = begins < len(raw)
                    begins, ends = begins[inside], ends[inside]
                kept = b"".join(raw[a:b] for a, b in zip(np.append(0, ends).tolist(), np.append(begins, len(raw)).tolist()))
                doc, times = doc.as_py(), times.as_py()
                row = (None if doc == _NO_ID else doc, times, len(raw), int((ends - begins).sum()), len(begins), hashlib.sha256(kept).hexdigest())
                rows.append(row + (([dict(start=a, end=b) for a, b in zip(begins.tolist(), ends.tolist())], kept) if with_text else ()))
            kinds = [pa.int64()] * 5 + [pa.string()]
            if with_text:
                kinds += [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            names = ["doc_id", "_times", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(kinds)])

    found = joined.mapInArrow(run, fields)
    if texts.filter("_times > 1").isEmpty():
        return found.drop("_times")
    return _with_copies(written(found, "kept-strings"), with_text)
