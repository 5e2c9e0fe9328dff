"""Spelling variants against brute force over all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

from telemill.llm import spelling

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, near = {}, {}
    for w, n in words.items():
        around = sorted((-m, v) for v, m in words.items() if one_edit(v, w))
        near[w] = len(around)
        if around and -around[0][0] >= 2 * n:
            form[w] = around[0][1]

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w, ""), root(w), n, near[w], words.get(form.get(w), 0)) for w, n in words.items())


def found(df):
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    return sorted(tuple(r[c] if r[c] is not None else ("" if c == "form" else 0) for c in columns) for r in spelling.variants(df).collect())


def test_equals_brute_force_on_close_words(spark):
    draw = random.Random(3)
    stems = ["".join(draw.choice("abeé") for _ in range(draw.choice((5, 6, 7)))) for _ in range(40)]
    words = stems + [w[:i] + draw.choice("abeéß") + w[i + draw.choice((0, 1)) :] for w in stems for i in (0, 2, len(w) - 1)]
    words += ["listen", "silent", "enlist", "aaaaa", "aaaaaa", "aaaaaaa"]
    text = [" ".join(draw.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=400)) for _ in range(12)]
    rows = list(enumerate(text, 1))
    want = brute(rows)
    assert any(r[1] and r[2] != r[1] for r in want)  # forms of forms
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_equals_brute_force_on_documents(spark, sample):
    rows = [(i, t) for i, t, _ in sample][:60]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_some_words_are_spoilt(spark):
    rows = [(i, "wonderful Wonderful") for i in range(400)]
    want = brute(rows)
    assert len(want) > 1
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, null ids, capitals beyond A-Z, extra columns."""
    rows = [(1, None), (2, ""), (3, "Apples apples APPLES apple apple apple"), (3, "Apples apples APPLES apple apple apple"), (None, "appley " * 3)]
    rows += [(4, "École école école École École école 12345 a1b2c\U0001f600apple"), (5, "x" * 300_000 + " " + "applet, " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n int, word string")
    assert found(df) == brute(rows)
    assert found(df.filter("false")) == []
    assert found(df.filter("doc_id = 4")) == brute([r for r in rows if r[0] == 4])
