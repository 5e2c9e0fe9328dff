"""Exact dedup, mixing, quality rules and line chunks: reference SQL on whole tables, odd rows, hot groups."""

import collections
import hashlib
import random

import pytest
from check_oracle import compare, connect

from telemill.llm import exact_dedup, line_chunks, mixing, quality, queries

from .conftest import SF, by_id

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas", "InArrow")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in queries.QUERIES.items() if sql))
def test_reference_sql(spark, db, name):
    plan, sql = queries.QUERIES[name]
    ok, note = compare(plan(spark, SF), db, sql)
    assert ok, note


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op5_mixing", "op6_quality", "op8_line_chunks"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in FORBIDDEN if bad in plan]


def with_foreign_columns(docs):
    return docs.selectExpr("*", "1 AS kept", "'x' AS _sha", "2 AS size", "3 AS _id", "4 AS taken", "5 AS _host", "6 AS _lines")


def test_exact_groups_of_odd_rows(documents):
    rows = [(1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (6, ""), (None, "a b"), (None, "alone"), (8, "x" * 1_000_000)]
    docs = with_foreign_columns(documents(*rows))
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect())
    assert got == sorted([
        (1, 2, 3, False), (2, 2, 3, True), (0, 2, 3, False), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 3, False), (6, 6, 3, True),
        (6, 6, 3, True), (0, 0, 1, True), (8, 8, 1, True),
    ])
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 6, None, 8}
    assert exact_dedup.exact_groups(documents()).count() == 0


@pytest.mark.parametrize("fan_in, rounds", [(2, 3), (8, 2), (3, 0)])
def test_every_tree_merges_alike(documents, fan_in, rounds):
    rows = documents(*[(i, f"text {i % 7}" if i % 3 else "the same") for i in range(400)])
    got = exact_dedup.merge_runs(exact_dedup.digests(rows), fan_in, rounds).collect()
    want = collections.defaultdict(list)
    for i in range(400):
        want[f"text {i % 7}" if i % 3 else "the same"].append(i)
    assert sorted((r.keep_id, r.group_size) for r in got) == sorted((max(v), len(v)) for v in want.values())
    assert {bytes(r._sha) for r in got} == {hashlib.sha256(t.encode()).digest() for t in want}


def test_targets_stop_and_are_shared_again(documents):
    texts = {"a": 10, "b": 100, "c": 1000, None: 5000}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(texts.items())]
    got = by_id(mixing.mix(documents(*rows)))
    # Weights 1, 2, 3, 1 of 6,110 words: a and b stop at 30 and 300, c at 3,000; the rest goes to the null source.
    assert [got[i]["target"] for i in range(4)] == [30.0, 300.0, 3000.0, 2780.0]
    assert [got[i]["taken"] for i in range(4)] == [30, 300, 3000, 5000]


@pytest.mark.parametrize("sf, share", [("0.001", 0.03), ("0.01", 0.01)])
def test_every_source_comes_near_its_target(spark, sf, share):
    """Within 1% of the target; sources of ten documents, which offer few sums, within 3%."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    by_source = collections.defaultdict(list)
    for r in rows:
        assert r.taken == r["size"] * len(r.copies) and len(r.copies) <= 3
        by_source[r.source].append(r)
    for source, found in by_source.items():
        target = found[0].target
        assert abs(sum(r.taken for r in found) - target) <= share * target, (source, target)


def test_gaps_are_filled_as_by_hand(documents):
    """One source of two: the fill against a plain loop, over many drawn sizes."""
    rng = random.Random(3)
    for _ in range(4):
        sizes = {i: rng.choice([0, 1, 3, 7, 20, 90, 400]) + rng.randrange(3) for i in range(rng.randrange(2, 25))}
        docs = documents(*[(i, "w " * n, "b") for i, n in sizes.items()], (1000, "w " * rng.randrange(1, 900), "a"))
        got = {i: r for i, r in by_id(mixing.mix(docs)).items() if i in sizes}
        target, total = got[0]["target"], sum(sizes.values())
        line = sorted(sizes, key=lambda i: hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest())
        copies, at, gap = collections.Counter(), 0, 0
        for i in line * 3:
            if sizes[i] and at + sizes[i] <= target:
                copies[i] += 1
            elif sizes[i] and at < target:
                gap = target - at
            at += sizes[i]
        left = sorted((i for i in line if sizes[i] and copies[i] < 3), key=lambda i: (-sizes[i], line.index(i)))
        for _ in range(mixing.FILL_ROUNDS):
            upto, taken = 0, []
            for i in left:
                if sizes[i] <= gap:
                    upto += sizes[i]
                    if upto <= gap:
                        taken.append(i)
            copies.update(taken)
            gap -= sum(sizes[i] for i in taken)
            left = [i for i in left if i not in taken]
        if left and sizes[left[-1]] <= 2 * gap:
            copies[left[-1]] += 1
        assert {i: len(r["copies"]) for i, r in got.items()} == {i: copies[i] for i in sizes}, (sizes, target, total)


def test_mix_of_many_documents(spark, documents):
    rows = [(i, "w " * (1 + i * 7919 % 97), "hot" if i % 3 == 0 else f"s{i % 7}" if i % 7 else None) for i in range(12_000)]
    docs = documents(*rows, (50_000, None, "hot"), (50_001, " ", "empty"), (None, "a b", "hot"), (1, "w w w", "s1"))
    mixed = mixing.mix(with_foreign_columns(docs)).cache()
    taken, target = collections.Counter(), {}
    sources = {r[0]: r[2] for r in rows} | {50_000: "hot", 50_001: "empty", None: "hot"}
    shards = collections.Counter()
    for r in mixed.collect():
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
        assert r.taken == r["size"] * len(r.copies) <= 3 * r["size"]
        shards.update(c.shard for c in r.copies)
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items()) and target["empty"] == 0
    assert set(shards) == set(range(16)) and max(shards.values()) < 1.5 * min(shards.values())
    assert mixed.exceptAll(mixing.mix(docs.repartition(5))).count() == 0
    out = mixing.mixed(with_foreign_columns(docs).filter("doc_id <> 1"))
    assert out.columns == with_foreign_columns(docs).columns and out.count() > 0
    assert mixing.mix(documents()).count() == 0


def test_blocks_are_split_exactly(spark):
    schema = "_no int, target double, _total long"
    sources = spark.createDataFrame([(1, 500.0, 1000), (2, 300.0, 1000), (3, 199.0, 1000), (4, 1.0, 1000), (5, 0.0, 1000)], schema)
    rows = mixing.block_shards(sources, depth=3, per_shard=10).collect()
    quotas = {r["_no"]: r["_quota"] for r in rows}
    assert quotas == {1: 40, 2: 24, 3: 16, 4: 1}
    shards = collections.Counter(s for r in rows for s in r["_shards"])
    assert sum(shards.values()) == 81 and set(shards.values()) <= {10, 11}
    assert all(len(r["_shards"]) == r["_quota"] for r in rows)


def test_quality_counts_and_odd_rows(documents):
    rows = [
        (1, LONG), (2, None), (3, ""), (4, "too short"), (5, LONG + LONG), (6, LONG + "\n \n# a\n# a\n#  a"), (7, "# $ <x> " * 30),
        (8, "\x0b\x1cé\xa0日 " + LONG), (8, "\x0b\x1cé\xa0日 " + LONG), (None, LONG), (9, LONG + "x" * 500_000),
    ]
    got = by_id(quality.quality(with_foreign_columns(documents(*rows))))
    value = lambda i: tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    size = len(LONG.replace(" ", ""))
    assert value(1) == (20, size, 0, 0, 0, False, True) == value(None)
    assert value(2) == value(3) == (0, 0, 0, 0, 0, True, False) and value(4)[-2:] == (True, False)
    assert value(5) == (40, 2 * size, 0, 0, 40, True, False)
    assert value(6)[:5] == (26, size + 6, 3, 1, 0)
    assert value(7)[2:] == (120, 0, 90, True, False)
    assert value(8)[:2] == (21, size + 4) and value(9)[0] == 21
    assert quality.quality(documents()).count() == 0


def test_frequent_lines_of_a_host_are_removed(documents):
    line = "Subscribe to our letter and never miss a thing again"
    rows = [(i, f"{line}\n{LONG}{i}\n{'Own line ' + str(i)}", "h") for i in range(60)]
    rows += [(100 + i, f" {line.upper()} \n{'only ' + str(i)}", "h") for i in range(5)]  # little else
    rows += [(200 + i, f"{line}\n{LONG}", "other" if i else None) for i in range(40)]  # below the limit there
    rows += [(300 + i, "Copied page line\n" + LONG, "copies") for i in range(90)]  # one text, many copies
    docs = documents(*rows)
    got = by_id(quality.quality(docs, min_texts=50))
    assert got[0]["n_kept_words"] == got[0]["n_words"] and got[1]["n_kept_words"] == got[1]["n_words"] - 10
    assert all(got[i]["kept"] for i in [*range(60), *range(201, 240), *range(300, 390)])
    assert not any(got[100 + i]["kept"] for i in range(5))
    clean = by_id(quality.without_frequent_lines(with_foreign_columns(docs), min_texts=50))
    assert clean[0]["text"].startswith(line) and clean[1]["text"] == f"{LONG}1\nOwn line 1" and clean[300]["text"] == rows[-1][1]
    assert clean[1]["n_chars"] == len(clean[1]["text"])
    kept = quality.keep_good(with_foreign_columns(docs), min_texts=50)
    assert kept.columns == with_foreign_columns(docs).columns and kept.count() == len(rows) - 5


def test_registered_quality_removes_lines_of_small_hosts(spark):
    sf = SF.replace("sf0.001", "sf0.01")  # 49 or 50 texts a host
    plan, sql = queries.QUERIES["op6_quality"]
    rows = plan(spark, sf).cache()
    ok, note = compare(rows, connect(sf), sql)
    assert ok, note
    assert rows.filter("n_kept_words < n_words").count() > 100
    assert rows.filter("NOT base_failed AND NOT kept").count() > 0


def test_limit_does_not_depend_on_the_number_of_texts(documents):
    # One line in 10% of the texts, whatever the host's size; three texts may agree by chance.
    rows = [(n * 1000 + i, f"{LONG}{n} {i}" + ("\nthe same line here" if i % 10 == 0 else ""), f"h{n}") for n in (30, 40, 400) for i in range(n)]
    got = by_id(quality.quality(documents(*rows)))
    lost = collections.Counter(i // 1000 if i < 400_000 else 400 for i, r in got.items() if r["n_kept_words"] == r["n_words"] - 4)
    assert lost == {40: 3, 400: 39}


def test_repeated_chunks(documents):
    def plain(rows):
        """The same rule, line by line."""
        seen, out = set(), {}
        for doc_id, text in sorted(rows, key=lambda r: r[0]):
            kept, chunk, before, lines = [], [], 0, (text or "").split("\n")
            for i, line in enumerate(lines):
                own = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
                chunk.append(line)
                if i == len(lines) - 1 or (own * 31 + before) % line_chunks.PRIME % line_chunks.DIVISOR == 0:
                    whole = "\n".join(chunk)
                    if len(chunk) < 2 or whole not in seen or not whole.split():
                        kept.append(whole)
                    seen |= {whole} if len(chunk) > 1 else set()
                    chunk = []
                before = own
            out[doc_id] = "\n".join(kept)
        return out

    block = [f"shared line {i}" for i in range(30)]
    rows = [(i, "\n".join([f"own {i} {k}" for k in range(i % 5)] + block[i % 4 :] + [f"tail {i}"])) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n" * 50), (103, "\n" * 50), (104, "\n".join(block * 3)), (105, "a\nb"), (106, "a\nb")]
    got = by_id(line_chunks.drop_repeated_chunks(with_foreign_columns(documents(*rows))))
    assert {i: r["text"] for i, r in got.items()} == plain(rows)
    assert sum(r["n_removed"] for r in got.values()) > 100
    assert line_chunks.drop_repeated_chunks(documents()).count() == 0
