"""Repeated strings against a dictionary of all strings; suffix arrays against sorted suffixes."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from telemill.llm import queries, suffix_dedup

from .conftest import SF, by_id


def plain(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, kept digest)."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - 99):
            string = raw[at : at + 100]
            if string in seen:
                gone[at : at + 100] = True
            seen.add(string)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out[doc_id] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def plain_rows(rows):
    """The same as a list, for rows whose ids repeat or are null: by id, then by a hash of the text."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))))
    found = plain(list(enumerate(t for _, t in order)))
    return sorted(((order[i][0], *v) for i, v in found.items()), key=repr)


def check(df, rows):
    got = {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in by_id(df).items()}
    want = plain(rows)
    assert got.keys() == want.keys()
    wrong = [(i, got[i], want[i]) for i in want if got[i] != want[i]]
    assert not wrong, (len(wrong), wrong[:5])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=80))
def test_induced_sorting_orders_suffixes(symbols):
    text = np.array(symbols, np.int64)
    want = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    assert suffix_dedup.suffix_array(text, 4).tolist() == want
    if len(symbols) > 1:
        shared = suffix_dedup.common_prefixes(text, np.array(want), 4)
        for a, b in zip(want, want[1:]):
            n = next((k for k in range(80) if symbols[a + k : a + k + 1] != symbols[b + k : b + k + 1] or not symbols[b + k : b + k + 1]), 80)
            assert shared[b] == n


@pytest.mark.parametrize("symbols", [2, 5, 257])
def test_induced_sorting_of_long_texts(symbols):
    rng = np.random.default_rng(symbols)
    block = rng.integers(0, symbols, 700)
    text = np.concatenate([rng.integers(0, symbols, 30_000), block, np.zeros(300, np.int64), block, block])
    raw = text.tolist()
    order = suffix_dedup.suffix_array(text, symbols)
    assert sorted(order.tolist()) == list(range(len(raw)))
    assert all(raw[a : a + 3000] <= raw[b : b + 3000] for a, b in zip(order.tolist(), order[1:].tolist()))


def planted(seed):
    rng = random.Random(seed)
    letters = "abcdefghij \n" + "éß"

    def words(n):
        return "".join(rng.choice(letters) for _ in range(n))

    passage, long = words(260), words(900)
    texts = [words(rng.randrange(50, 900)) for _ in range(30)]
    texts += [words(rng.randrange(80)) + passage + words(rng.randrange(200)) for _ in range(25)]
    for _ in range(25):  # near copies
        other = list(long)
        for _ in range(rng.randrange(1, 6)):
            other[rng.randrange(len(other))] = "Z"
        texts.append("".join(other))
    texts += [long] * 5 + [words(90) + passage[80:190] + passage[:150] + passage]
    texts += ["a" * 99, "a" * 100, "a" * 101, "a" * 1500, "ab" * 700, "abc" * 400 + "x" + "abc" * 300, "", None, "é" * 300]
    texts += [passage[:99], passage[:100], passage[1:101], long[100:220], words(99) + "\0" * 250 + words(50) + "\0" * 120]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_registered_query_removes_what_a_dictionary_removes(spark, sample):
    check(queries.op2_suffix_dedup(spark, SF), [(d, t) for d, t, _ in sample])


@pytest.mark.parametrize("hot, piece", [(20_000, 1 << 19), (3, 1 << 19), (20_000, 700)])
def test_planted_repeats(documents, monkeypatch, hot, piece):
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", hot)
    rows = planted(hot + piece)
    docs = documents(*rows)
    if piece != suffix_dedup.SLICE_BYTES:  # workers import the module anew, so long pieces are tried here
        monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", piece)
        docs = documents(*rows, (9_999, "x" * 50 + "long text " * 300_000))
        rows.append((9_999, "x" * 50 + "long text " * 300_000))
    check(suffix_dedup.drop_repeated_strings(docs, with_text=False), rows)


def test_spans_and_bytes_and_odd_rows(documents):
    text = "".join(chr(97 + i * i % 23) + chr(97 + i % 19) for i in range(80))
    docs = documents((1, text), (2, "ü" + text + "ü"), (None, None)).selectExpr("*", "1 AS _doc", "2 AS spans")
    got = by_id(suffix_dedup.drop_repeated_strings(docs))
    assert got[1]["spans"] == [] and bytes(got[1]["kept"]) == text.encode()
    assert [tuple(s) for s in got[2]["spans"]] == [(2, 162)] and bytes(got[2]["kept"]) == "üü".encode()
    assert got[None]["n_bytes"] == 0
    assert suffix_dedup.drop_repeated_strings(documents()).count() == 0


def test_rows_that_repeat_ids_and_texts_keep_one_copy(documents):
    """Every text of 100 bytes or more survives once, whatever ids its rows have."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (400, 300, 50, 250, 99)]
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[2] + texts[1]), (2, texts[3]), (2, "x" + texts[3]), (2, texts[3])]
    rows += [(3, texts[4])] * 3 + [(None, "")] * 2 + [(4, None), (4, "")] + [(5, texts[0])] * 300 + [(6, texts[4] + "z")] * 2
    docs = documents(*rows)
    got = suffix_dedup.drop_repeated_strings(docs, with_text=False)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == plain_rows(rows)
    full = suffix_dedup.drop_repeated_strings(docs).collect()
    kept = b"|".join(bytes(r["kept"]) for r in full)
    assert all(t.encode() in kept for t in texts) and len(full) == len(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(e - b for b, e in r["spans"]) == r["n_removed"] for r in full)
