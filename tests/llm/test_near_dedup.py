"""Components of near duplicates against all pairs of plain sets."""

import random
import re

import numpy as np

from telemill.llm import near_dedup, queries

from .conftest import SF, by_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_components(rows):
    """doc_id -> (n_shingles, component_id) by an index of shingles; every pair that shares one is compared."""
    sets = {i: plain_set(t) for i, t in rows}
    holders, root = {}, {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)
    for i, own in sets.items():
        common = {}
        for s in own:
            for j in holders[s]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(df, rows):
    got, want = by_id(df), plain_components(rows)
    assert got.keys() == want.keys()
    wrong = {i: (got[i]["n_shingles"], got[i]["component_id"], w) for i, w in want.items() if (got[i]["n_shingles"], got[i]["component_id"]) != w}
    assert not wrong, list(wrong.items())[:5]
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_registered_query_finds_what_all_pairs_find(spark, sample):
    check(queries.op10_near_dedup(spark, SF), [(d, t) for d, t, _ in sample])


def test_chains_templates_and_edges(documents):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, at = [], 0

    def add(words):
        nonlocal at
        rows.append((at, " ".join(words)))
        at += 1

    for length in (12, 40, 200):  # chains: each step changes little, the ends are far apart
        words = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(25):
            add(words)
            words = list(words)
            words[rng.randrange(length)] = rng.choice(vocabulary)
    template = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(150):  # one template, other places filled: many share buckets, few are linked
        words = list(template)
        for _ in range(rng.randrange(2, 9)):
            words[rng.randrange(120)] = rng.choice(vocabulary)
        add(words)
    for text in ("", " \n", "A b", "a B", "a b c d e", "A B C D E", "a b c d e f", "x " * 50, "x " * 900, "é É", "é é"):
        rows.append((at, text))
        at += 1
    rows += [(at, None), (at + 1, " ".join(rng.choice(vocabulary) for _ in range(30_000)))]
    rng.shuffle(rows)
    check(near_dedup.near_groups(documents(*rows)), rows)


def test_no_rows_null_ids_repeats_and_foreign_columns(spark, documents):
    assert near_dedup.near_groups(documents()).count() == 0
    rows = [(None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (None, "only here without an id at all")]
    docs = documents(*rows).selectExpr("*", "1 AS kept", "'x' AS _rep", "2 AS component_id")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_groups(docs).collect())
    assert got == [(0, 0, True), (0, 4, False), (4, 4, True), (4, 4, True)]
    assert near_dedup.drop_near(docs.filter("doc_id = 4")).columns == docs.columns


def test_odd_sketches_tell_similar_sets():
    rng = np.random.default_rng(3)
    for n in (8, 150, 1500, 20_000):
        for similarity, passes in ((1.0, True), (0.9, True), (0.76, True), (0.55 if n > 1000 else 0.4 if n > 100 else 0.0, False)):
            for _ in range(25):
                common = rng.integers(0, 2**63, int(np.ceil(2 * n * similarity / (1 + similarity))), dtype=np.uint64)
                sides = [np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for _ in range(2)]
                low = [near_dedup.bin_samples(s) for s in sides]
                one, other = ({"n": np.array([len(s)]), "k": np.array([len(x)]), "sketch": np.frombuffer(near_dedup.odd_sketch(x), np.uint64)[None]}
                              for s, x in zip(sides, low))
                assert near_dedup._likely(one, other)[0] == passes, (n, similarity)


def test_blocks_of_a_large_bucket_meet(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(1, 8)):
            words[rng.randrange(150)] = f"x{rng.randrange(500)}"
        rows.append((i, " ".join(words)))
    check(near_dedup.near_groups(documents(*rows)), rows)
