"""Clustering over cells against plain Lloyd rounds on full vectors."""

import hashlib
import math

import numpy as np
import pytest

from telemill.llm import va_clusters

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=8, rounds=10, dims=64):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest), sorted."""
    kept = []
    for vec_id, v in rows:
        if v is None or len(v) != dims or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [math.floor(1024 * float(np.float32(x))) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for i, members in groups.items():
            centroids[i] = [sum(x) // len(members) for x in zip(*members)]
    last = [(vec_id, *nearest(v)[::-1]) for vec_id, v in kept]
    inertia = {}
    for _, c, d in last:
        inertia[c] = inertia.get(c, 0) + d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digests[c]) for i, c, d in last), key=repr)


def found(df, **options):
    result = va_clusters.cluster(df, **options)
    return result, sorted((tuple(r) for r in va_clusters.with_inertia(result).collect()), key=repr)


@pytest.mark.parametrize("bits", [2, 6])
def test_equals_plain_rounds_on_clustered_vectors(spark, bits):
    draw = np.random.default_rng(5)
    centres = draw.normal(0, 0.4, (8, 64))
    rows = [(i, (centres[i % 8] + draw.normal(0, 0.05, 64)).astype(np.float32).tolist()) for i in range(600)]
    result, got = found(spark.createDataFrame(rows, SCHEMA), bits=bits)
    assert got == plain(rows)
    if bits == 6:  # cells settle most of what full vectors would
        assert sum(result.fetched) < 0.5 * len(rows) * max(1, len(result.fetched))


def test_equals_plain_rounds_on_vectors_without_clusters(spark):
    draw = np.random.default_rng(6)
    rows = [(int(i), (draw.normal(0, 0.125, 64)).astype(np.float32).tolist()) for i in range(300)]
    assert found(spark.createDataFrame(rows, SCHEMA))[1] == plain(rows)


def test_odd_rows(spark):
    """Nulls, other lengths, nan, infinities, repeated rows and ids, ties, null ids, extra columns."""
    draw = np.random.default_rng(7)
    good = [(i, draw.normal(0, 0.2, 64).astype(np.float32).tolist()) for i in range(12)]
    odd = [(20, None), (21, []), (22, [0.5] * 63), (23, [None] + [0.1] * 63), (24, [math.nan] * 64), (25, [math.inf] + [0.0] * 63)]
    ties = [(30, [0.25] * 64), (30, [0.25] * 64), (31, [-0.25] * 64), (None, [0.25] * 64), (None, [0.0] * 64)]
    rows = good + odd + ties + [good[3]]
    df = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], SCHEMA + ", cluster int, block string, cells binary")
    assert found(df)[1] == plain(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-1.0] * 64)]
    assert found(spark.createDataFrame(rows, SCHEMA))[1] == plain(rows)
    assert found(spark.createDataFrame([], SCHEMA))[1] == []
    assert found(spark.createDataFrame([(1, None)], SCHEMA))[1] == []


def test_components_beyond_64_bit_distances_are_refused(spark):
    with pytest.raises(Exception, match="is beyond"):
        va_clusters.cluster(spark.createDataFrame([(1, [1e9] * 64)], SCHEMA))
