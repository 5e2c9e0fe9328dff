"""The additive quality model: accuracy on held-out rows, its tables, odd rows."""

import zlib

import numpy as np
import pytest

from telemill.llm import quality_gam

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality_gam.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    truth = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = ([r["score"] for r, q in truth if q == want] for want in (1, 0))
    assert len(bad) > 10
    assert np.mean([r["predicted"] == q for r, q in truth]) > 0.97
    assert np.mean([g > b for g in good for b in bad]) > 0.98  # area under the curve


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    want, got = ({r["doc_id"]: r["score"] for r in quality_gam.classify(docs, x).collect()} for x in (labels, turned))
    assert want == got


def test_score_is_a_sum_of_table_entries():
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(800, 3))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0)).astype(int)  # no single feature says anything
    alone, both = quality_gam.fit(rows, labels, pairs=0), quality_gam.fit(rows, labels)
    fresh = draw.normal(size=(800, 3))
    truth = (fresh[:, 0] > 0) ^ (fresh[:, 1] > 0)
    assert ((alone.scores(fresh) >= 0.5) == truth).mean() < 0.65
    assert ((both.scores(fresh) >= 0.5) == truth).mean() > 0.9
    assert both.pairs[0][:2] == (0, 1)
    for row, odds in zip(both.bins(fresh)[:20], both.log_odds(both.bins(fresh))):
        parts = [shape[b] for shape, b in zip(both.shapes, row)] + [t[row[f], row[g]] for f, g, t in both.pairs]
        assert np.isclose(both.start + sum(parts), odds)


def test_slices_do_not_change_features():
    text = "\n".join(f"Line {i} of words, {'x' * (i % 20)} again again. #tag |" for i in range(300))
    assert np.allclose(quality_gam.features(text), quality_gam.features(text, size=64))
    assert len(quality_gam.features("y" * 1000, size=64)) == len(quality_gam.FEATURES)
    assert not any(quality_gam.features(None)) and not any(quality_gam.features(""))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 7), (1, None, 7), (None, "some words here", 8), (2, "", 9), (3, "a " * 200_000, 9), (4, "Good text.", 1)],
        "doc_id long, text string, score int",
    )
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, 1), (4, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = quality_gam.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    none = quality_gam.classify(docs, labels.filter("false")).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}
    assert quality_gam.classify(docs.filter("false"), labels).collect() == []


@pytest.mark.parametrize("label", [0, 1])
def test_one_class(label):
    model = quality_gam.fit(np.ones((9, 2)), np.full(9, label))
    assert (model.scores(np.zeros((2, 2))) >= 0.5).tolist() == [bool(label)] * 2
