"""Lloyd's clustering of integer vectors over a vector-approximation file.

The file holds a vector and its cells side by side: every component becomes the number of one of ``2 ** bits`` cells
whose edges follow the dimension's mean and spread.  For a set of centroids, two tables per dimension give the least
and the greatest squared difference of each cell's values (less a term that all centroids share), so that sums of
looked-up entries bound every distance.  A
vector whose nearest centroid the intervals settle is never looked at again in that round; only where intervals
overlap, or where the settled centroid has changed since the round before, its full components are needed.

Centroid sums are carried from round to round and corrected by the vectors that moved.  A round first reads the cells
alone and counts, per block, the vectors it has to look at; then it opens only blocks that have some.  Blocks are
folders of the file, by how much nearer the nearest centroid was than the next when the file was built.  All arithmetic
is on 64-bit integers; cells decide what is read, never what comes out.  What reaches the driver is centroids, sums per
cluster and dimension, and one count per block.

Vectors that have another length, null or non-finite components are left out.  A null id counts as an empty string when
the first centroids are drawn; rows that repeat an id are vectors of their own, and equal hashes are ordered by
components.  Fewer than k vectors give as many centroids, none give no rows.  Other columns are not read.  Components
beyond 2 ** 26 would not leave room for 64-bit distances and raise ValueError.  Vectors are of fixed length, so texts
play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import written
from telemill.session import shared_dir

DIMS = 64
SCALE = 1024
BITS = 8
BLOCKS = 8
#: Largest size of a component, so that a squared distance over 64 dimensions stays below 2 ** 60.
LARGEST = 1 << 26
_CHUNK = 8192


def _integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and their components."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    flat = column.filter(fits).flatten().cast(pa.float64())
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)  # a null component arrives as nan
    keep = np.asarray(fits.to_numpy(zero_copy_only=False), bool)
    keep[keep] = finite
    scaled = np.floor(values[finite] * scale)
    if np.abs(scaled).max(initial=0) > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    return keep, scaled.astype(np.int64)


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    raw = np.ascontiguousarray(rows)
    if not len(raw):
        return pa.array([], pa.binary())
    offsets = np.arange(len(raw) + 1, dtype=np.int64) * raw[0].nbytes
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(raw), buffers).cast(pa.binary())


def _matrix(column: pa.Array, dtype, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dims)


def _distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every vector to every centroid."""
    vectors = vectors.astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


@dataclass
class Grid:
    """The cells: per dimension the inner edges, and the least and greatest value there is."""

    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(e, vectors[:, j], "right") for j, e in enumerate(self.edges)]
        return np.stack(columns, axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """dimension, cell, (least entry per centroid, then greatest per centroid).

        An entry is the squared difference to the centroid less that to the middle of all centroids.  What is taken
        off is the same for every centroid, and what is left is linear in the component, so its intervals are narrow.
        """
        middle = (centroids.sum(axis=0) // len(centroids))[:, None, None]
        at = centroids.T[:, None, :]
        first = np.concatenate([self.low[:, None], self.edges], axis=1)[:, :, None]
        last = np.concatenate([self.edges - 1, self.high[:, None]], axis=1)[:, :, None]
        ends = [(x - at) ** 2 - (x - middle) ** 2 for x in (first, last)]
        return np.concatenate([np.minimum(*ends), np.maximum(*ends)], axis=2)


def _settled(cells: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The nearest centroid where the intervals leave one, else -1.  Of equally near ones the first is meant."""
    k = tables.shape[2] // 2
    bounds = np.zeros((len(cells), 2 * k), np.int64)
    for j, entries in enumerate(tables):
        bounds += entries[cells[:, j]]
    least, greatest = bounds[:, :k], bounds[:, k:]
    best = greatest.argmin(axis=1)
    limit = greatest[np.arange(len(cells)), best][:, None]
    later = np.arange(k)[None, :] > best[:, None]
    out = (least > limit) | ((least == limit) & later)
    out[np.arange(len(cells)), best] = True
    return np.where(out.all(axis=1), best, -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK):
            yield batch.slice(at, _CHUNK)


def _add(sums: np.ndarray, counts: np.ndarray, where: np.ndarray, vectors: np.ndarray, sign: int = 1) -> None:
    for c in range(len(sums)):
        sums[c] += sign * vectors[where == c].sum(axis=0)
    counts += sign * np.bincount(where, minlength=len(sums))


def _sum_rows(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sums per cluster and dimension as rows; dimension -1 holds the counts."""
    k, dims = sums.shape
    table = np.concatenate([counts[:, None], sums], axis=1)
    return pa.RecordBatch.from_pydict(
        {"cluster": np.repeat(np.arange(k), dims + 1), "dim": np.tile(np.arange(-1, dims), k), "value": table.ravel()}
    )


def _collected(rows: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for cluster, dim, value in rows.groupBy("cluster", "dim").agg(F.sum("value")).collect():
        if dim < 0:
            counts[cluster] = value
        else:
            sums[cluster, dim] = value
    return sums, counts


def _first_round(batches: Iterator[pa.RecordBatch], start: np.ndarray, dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Sums of the first assignment; after them, per dimension, count, sum, square sum, least and greatest value."""
    k = len(start)
    sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    total, squares = np.zeros(dims), np.zeros(dims)
    low, high, n = np.full(dims, LARGEST, np.int64), np.full(dims, -LARGEST, np.int64), 0
    for batch in _chunks(batches):
        _, vectors = _integers(batch.column("embedding"), dims, scale)
        nearest = _distances(vectors, start).argmin(axis=1)
        _add(sums, counts, nearest, vectors)
        total += vectors.sum(axis=0)
        squares += (vectors.astype(np.float64) ** 2).sum(axis=0)
        low, high, n = np.minimum(low, vectors.min(axis=0, initial=LARGEST)), np.maximum(high, vectors.max(axis=0, initial=-LARGEST)), n + len(vectors)
    moved = _sum_rows(sums, counts).to_pydict()
    empty = [None] * dims
    yield pa.RecordBatch.from_pydict(
        {
            "cluster": pa.array(moved["cluster"] + empty, pa.int64()),
            "dim": pa.array(moved["dim"] + list(range(dims)), pa.int64()),
            "value": pa.array(moved["value"] + empty, pa.int64()),
            "n": pa.array([None] * len(moved["dim"]) + [n] * dims, pa.int64()),
            "total": pa.array([None] * len(moved["dim"]) + total.tolist(), pa.float64()),
            "squares": pa.array([None] * len(moved["dim"]) + squares.tolist(), pa.float64()),
            "low": pa.array([None] * len(moved["dim"]) + low.tolist(), pa.int64()),
            "high": pa.array([None] * len(moved["dim"]) + high.tolist(), pa.int64()),
        }
    )


def first_centroids(rows: DataFrame, k: int, seed: str, dims: int, scale: int) -> np.ndarray:
    """The vectors whose ids hash lowest, in that order."""

    def kept(batches):
        for batch in _chunks(batches):
            keep, vectors = _integers(batch.column("embedding"), dims, scale)
            yield pa.RecordBatch.from_pydict({"key": batch.column("key").filter(pa.array(keep)), "vector": vectors.tolist()})

    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    drawn = rows.select("embedding", key.alias("key")).mapInArrow(kept, "key string, vector array<long>")
    return np.array([r["vector"] for r in drawn.orderBy("key", "vector").limit(k).collect()], np.int64).reshape(-1, dims)


def _grid(rows: list, dims: int, bits: int) -> Grid:
    """Cell edges at the quantiles of a normal distribution with the dimension's mean and spread."""
    marks = np.array([NormalDist().inv_cdf(i / (1 << bits)) for i in range(1, 1 << bits)])
    edges, low, high = np.zeros((dims, len(marks)), np.int64), np.zeros(dims, np.int64), np.zeros(dims, np.int64)
    for dim, n, total, squares, least, greatest in rows:
        mean = total / n
        spread = max(squares / n - mean**2, 0.0) ** 0.5
        low[dim], high[dim] = least, greatest
        edges[dim] = np.clip(np.round(mean + spread * marks), least, greatest + 1)
    return Grid(edges, low, high)


def _with_cells(batches, centroids: np.ndarray, grid: Grid, dims: int, scale: int, blocks: int):
    """vec_id, cells, vector and the block: how clear the nearest centroid was."""
    for batch in _chunks(batches):
        keep, vectors = _integers(batch.column("embedding"), dims, scale)
        far = np.sort(_distances(vectors, centroids), axis=1)
        if far.shape[1] > 1:
            lead = (far[:, 1] - far[:, 0]) / np.maximum(far[:, 0] + far[:, 1], 1)
        else:
            lead = np.ones(len(far))
        block = np.minimum(blocks - 1, (blocks * np.sqrt(lead)).astype(np.int32))
        yield pa.RecordBatch.from_pydict(
            {
                "vec_id": batch.column("vec_id").filter(pa.array(keep)),
                "cells": _packed(grid.cells(vectors)),
                "vector": _packed(vectors.astype(np.int32)),
                "block": pa.array(block, pa.int32()),
            }
        )


def _open(cells: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Vectors that the cells do not show to have stayed where they were."""
    now = _settled(cells, new)
    return (now < 0) | (_settled(cells, old) != now)


def _moves(file: DataFrame, old: np.ndarray, new: np.ndarray, grid: Grid, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """What the sums and counts of the clusters change by, and how many vectors were fetched."""
    k = len(new)

    def wanted(batches):
        tables, found = (grid.tables(old), grid.tables(new)), {}
        for batch in _chunks(batches):
            block = batch.column("block").to_numpy()[_open(_matrix(batch.column("cells"), np.uint8, dims), *tables)]
            for b, n in zip(*np.unique(block, return_counts=True)):
                found[int(b)] = found.get(int(b), 0) + int(n)
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(found), pa.int32()), "n": pa.array(found.values(), pa.int64())})

    def changes(batches):
        tables = grid.tables(old), grid.tables(new)
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in _chunks(batches):
            at = np.flatnonzero(_open(_matrix(batch.column("cells"), np.uint8, dims), *tables))
            vectors = _matrix(batch.column("vector").take(pa.array(at)), np.int32, dims).astype(np.int64)
            before, after = (_distances(vectors, c).argmin(axis=1) for c in (old, new))
            moved = before != after
            _add(sums, counts, before[moved], vectors[moved], -1)
            _add(sums, counts, after[moved], vectors[moved])
        yield _sum_rows(sums, counts)

    needed = file.select("block", "cells").mapInArrow(wanted, "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).collect()
    if not needed:
        return np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
    opened = file.filter(F.col("block").isin([r["block"] for r in needed])).select("cells", "vector")
    return *_collected(opened.mapInArrow(changes, "cluster long, dim long, value long"), k, dims), sum(r["n"] for r in needed)


def _means(sums: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], before)


@dataclass
class Clustering:
    """assigned: vec_id, cluster, distance.  fetched: vectors looked at in full, by round after the first."""

    assigned: DataFrame
    centroids: np.ndarray
    fetched: list[int]


def cluster(
    rows: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", dims: int = DIMS, scale: int = SCALE, bits: int = BITS
) -> Clustering:
    """Cluster ``rows`` (vec_id, embedding): ``rounds`` of assignment and means, then a last assignment.

    Components are floor(scale * x).  ``bits`` (at most 8) only decides how often full vectors are needed.
    """
    rows = rows.select("vec_id", "embedding")
    start = first_centroids(rows, k, seed, dims, scale)
    if not len(start):
        nothing = rows.filter("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(nothing, start, [])
    k, spark = len(start), rows.sparkSession

    schema = "cluster long, dim long, value long, n long, total double, squares double, low long, high long"
    summed = rows.mapInArrow(lambda batches: _first_round(batches, start, dims, scale), schema)
    totals = [F.sum(c).alias(c) for c in ("value", "n", "total", "squares")]
    found = summed.groupBy("cluster", "dim").agg(*totals, F.min("low").alias("low"), F.max("high").alias("high")).collect()
    sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for r in found:
        if r["cluster"] is not None and r["dim"] < 0:
            counts[r["cluster"]] = r["value"]
        elif r["cluster"] is not None:
            sums[r["cluster"], r["dim"]] = r["value"]
    grid = _grid([(r["dim"], r["n"], r["total"], r["squares"], r["low"], r["high"]) for r in found if r["cluster"] is None], dims, bits)

    old, new, fetched = start, (_means(sums, counts, start) if rounds else start), []
    path = shared_dir(spark, "va-file")
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cells binary, vector binary, block int"
    layout = rows.mapInArrow(lambda batches: _with_cells(batches, new, grid, dims, scale, BLOCKS), schema)
    layout.write.partitionBy("block").parquet(path)
    file = spark.read.schema(layout.schema).parquet(path)
    for _ in range(1, rounds):
        if (old == new).all():  # the means stand still: further rounds change nothing
            break
        by, n, looked_at = _moves(file, old, new, grid, dims)
        sums, counts = sums + by, counts + n
        old, new = new, _means(sums, counts, new)
        fetched.append(looked_at)

    def last(batches):
        tables = grid.tables(new)
        for batch in _chunks(batches):
            nearest = _settled(_matrix(batch.column("cells"), np.uint8, dims), tables)
            vectors = _matrix(batch.column("vector"), np.int32, dims).astype(np.int64)
            open_ = nearest < 0
            nearest[open_] = _distances(vectors[open_], new).argmin(axis=1)
            distance = ((vectors - new[nearest]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_pydict(
                {"vec_id": batch.column("vec_id"), "cluster": pa.array(nearest, pa.int32()), "distance": pa.array(distance, pa.int64())}
            )

    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    assigned = file.select("vec_id", "cells", "vector").mapInArrow(last, schema)
    return Clustering(written(assigned, "va-clusters"), new, fetched)


def with_inertia(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (of its decimal components)."""
    per_cluster = {c: int(s) for c, s in found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]

    def of(values: list, kind: str):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)

    return found.assigned.select(
        "vec_id",
        "cluster",
        "distance",
        of([per_cluster.get(c, 0) for c in range(len(digests))], "long").alias("cluster_inertia"),
        F.lit(sum(per_cluster.values())).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
    )
