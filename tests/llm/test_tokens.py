"""Encoding, decoding and token shards against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from telemill.llm import bpe, queries, token_shards
from telemill.session import shared_dir

from .conftest import by_id

RANKS = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
JSON = str(public_tokenizers.path("byte_bpe_50k.json"))
PATTERN = public_tokenizers.PATTERN
ODD = [
    "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\n b", "I'll  don't 's x's", " a  b", "é \x1c x", "日本語 テキスト",
    "👩‍👩‍👧 ok", "a" * 3000, " " * 300 + "x", "<|endoftext|> x", "!" * 40 + " !", "1 234  56,7", "\x85 a", "\x1f \x1f", "᠎ ​",
    "\t\ta \x0b b\r\n", "a\xa0 b", "a \u2003b\u3000 c", "été's «fin» ×2 ÷ñ, ¿", "foo\nbar.\nBaz\n", "x\x1d y", "« a", "don't've", "﻿x", "ſ K", "aaa aaaa aaaaa" * 50,
]


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def encoded(encoder, texts):
    ids, stops = encoder.encode(pa.array([t.encode() for t in texts], pa.large_binary()))
    return [i.tolist() for i in np.split(ids, stops[:-1])]


def test_encoding_is_that_of_the_ranks(tik, sample):
    encoder, table, _ = bpe.rank_codec(RANKS, PATTERN)
    texts = ODD + [t or "" for _, t, _ in sample]
    got = encoded(encoder, texts)
    assert got == [tik.encode_ordinary(t) for t in texts]
    assert [b"".join(table[i] for i in ids).decode() for ids in got] == texts


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'stlre \n\t é1.,!\x1c\x85日👩​"), max_size=60))
def test_units_encode_like_whole_texts(text):
    own = bpe.rank_codec(RANKS, PATTERN)[0]
    tik = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}) if not hasattr(own, "tik") else own.tik
    own.tik = tik
    assert encoded(own, [text, text + " b"]) == [tik.encode_ordinary(text), tik.encode_ordinary(text + " b")]


def test_offsets_decoding_and_digests(documents, tik):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(900, None), (900, "twice"), (None, "no id")]
    docs = documents(*rows)
    encoded = bpe.encode(docs.selectExpr("doc_id", "text", "1 AS ids", "'x' AS starts"), RANKS, PATTERN)
    for row in encoded.filter("doc_id < 900").collect():
        text = ODD[row.doc_id]
        assert len(row.ids) == len(row.starts) == len(row.ends)
        assert all(0 <= s < e <= len(text) for s, e in zip(row.starts, row.ends))
        covered = {i for s, e in zip(row.starts, row.ends) for i in range(s, e)}
        assert covered == set(range(len(text)))
    decoded = bpe.decode(encoded, RANKS, PATTERN)
    assert sorted((r.doc_id or -1, r.text) for r in decoded.collect()) == sorted((-1 if i is None else i or -1, t or "") for i, t in rows)
    digests = by_id(bpe.round_trips(docs, RANKS, PATTERN).filter("doc_id < 900"))
    for i, text in enumerate(ODD):
        ids = tik.encode_ordinary(text)
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trips(documents(), RANKS, PATTERN).count() == 0


def test_wavelet_matrix_answers_from_its_file():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 300, 100_000).astype("<u4")
    shard = token_shards.Shard(token_shards.build(ids, [5, None], [60_000, 40_000]))
    assert shard.doc_ids == [5, None] and shard.lengths.tolist() == [60_000, 40_000]
    assert (shard.ids() == ids).all()
    for at in (0, 1, 32_767, 32_768, 70_000, 99_999):
        assert shard.access(at) == ids[at]
    for token in (0, 7, 299):
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places) and shard.count(token, 50_000) == (places < 50_000).sum()
        assert [shard.locate(token, k) for k in (0, 3, len(places) - 1)] == places[[0, 3, -1]].tolist()
    assert shard.count(1000) == 0 and shard.count(400) == 0
    with pytest.raises(IndexError):
        shard.locate(400, 0)


def test_shard_file_holds_stable_planes():
    rng = np.random.default_rng(5)
    for n, top in ((0, 2), (1, 1), (7, 2), (70_001, 50_257), (40_000, 90_000)):
        ids = rng.integers(0, top, n).astype("<u4")
        shard = token_shards.Shard(token_shards.build(ids, [1], [n]))
        current = ids.tolist()
        for plane in range(shard.bits):
            ones = [i >> (shard.bits - 1 - plane) & 1 for i in current]
            blocks = [ones[b : b + token_shards.BLOCK_BITS] for b in range(0, n, token_shards.BLOCK_BITS)]
            assert [shard.block(plane, k).tolist() for k in range(len(blocks))] == blocks
            assert shard.ranks[plane].tolist() == [sum(map(sum, blocks[:k])) for k in range(len(blocks))]
            current = [i for i, one in zip(current, ones) if not one] + [i for i, one in zip(current, ones) if one]
            assert shard.zeros[plane] == n - sum(ones)
        assert (shard.ids() == ids).all() and len(shard.ids()) == n


def test_units_in_use_are_encoded_once(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_UNITS", 40)
    whole = Tokenizer.from_file(JSON)
    own = token_shards.file_encoder.__wrapped__(JSON, True)
    learned = []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda units: learned.extend(units) or learn(units))
    common = " ".join(f"often{chr(97 + i)}" for i in range(20))
    for k in range(30):
        rare = " ".join(f"seldom{chr(97 + k % 26)}{chr(97 + i)}{'z' * (k // 26)}" for i in range(15))
        text = f"{common} {rare}"
        assert encoded(own, [text]) == [whole.encode(text, add_special_tokens=False).ids]
        assert len(own.known) < 100
    assert sum(b"often" in u for u in learned) == 20
    assert len(own.known) == len(own.counts) == len(own.uses) and len(own.flat) == own.counts.sum()


def test_long_units_do_not_pile_up(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_BYTES", 20_000)
    whole = Tokenizer.from_file(JSON)
    own = token_shards.file_encoder.__wrapped__(JSON, True)
    for k in range(12):
        text = f"short {chr(97 + k) * 5_000} " + "日本" * 20 + str(k) * 900
        assert encoded(own, [text, ""]) == [whole.encode(text, add_special_tokens=False).ids, []]
        assert own.known.nbytes < 30_000 and len(own.flat) == own.counts.sum()


def test_the_library_holds_few_new_units_at_once(monkeypatch):
    whole = Tokenizer.from_file(JSON)
    own = token_shards.file_encoder.__wrapped__(JSON)
    asked, encode = [], own._whole
    monkeypatch.setattr(own, "_whole", lambda texts: asked.append((len(texts), sum(map(len, texts)))) or encode(texts))
    text = " ".join(f"{k} word{''.join(chr(97 + int(c)) for c in str(k))}" for k in range(30_000))
    assert encoded(own, [text, ""]) == [whole.encode(text, add_special_tokens=False).ids, []]
    assert max(n for n, _ in asked) <= 8192 and max(size for _, size in asked) < 150_000
    rows = pa.array([b"a" * 300_000] * 20, pa.large_binary())
    assert max(end - begin for begin, end in bpe.slices(rows)) <= 3


def test_slices_are_numbered_together(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 400)
    whole = Tokenizer.from_file(JSON)
    own = token_shards.file_encoder.__wrapped__(JSON, True)
    rows = [(k, f"often {k} w{chr(97 + k % 26) * (k // 26 + 1)} " * 12 if k % 5 else None) for k in range(60)]
    batch = pa.RecordBatch.from_pylist([dict(doc_id=k, text=t) for k, t in rows])
    count = len(list(bpe.slices(pa.array([(t or "").encode() for _, t in rows], pa.large_binary()))))
    calls, learn = [], own._learn
    monkeypatch.setattr(own, "_learn", lambda units: calls.append(len(units)) or learn(units))
    got = [(k, ids.tolist()) for part, all_ids in bpe.encoded_batches(batch, own) for k, ids in zip(part.column("doc_id").to_pylist(), all_ids)]
    assert got == [(k, whole.encode(t or "", add_special_tokens=False).ids) for k, t in rows]
    assert count > 16 and len(calls) <= -(-count // bpe.SLICES_TOGETHER)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ é×÷ÿÀ日1'\n\xa0"), min_size=1, max_size=5), min_size=1, max_size=30))
def test_sure_words_are_letters_after_a_space_at_most(texts):
    units = [t.encode() for t in texts]
    sizes = np.array(list(map(len, units)))
    sure = bpe.sure_words(np.frombuffer(b"\n".join(units), np.uint8), np.cumsum(sizes + 1) - sizes - 1, sizes)
    assert sure.tolist() == [(w := t[t[0] == " " :]).isalpha() and "日" not in w for t in texts]


def test_shards_hold_every_document_in_order(spark, documents, sample):
    rows = [(d, t) for d, t, _ in sample] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None), (20_001, "x " * 60_000)]
    out = shared_dir(spark, "shards")
    token_shards.write_shards(documents(*rows), out, JSON, shard_tokens=5_000)
    files = spark.read.parquet(out)
    assert files.count() > 20
    got = by_id(token_shards.read_shards(files))
    whole, start = Tokenizer.from_file(JSON), 0
    whole.encode_special_tokens = True
    for doc_id, text in sorted(rows):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = dict(doc_id=doc_id, start=start, n_tokens=len(ids), ids_crc32=zlib.crc32(ids.tobytes()))
        assert got.pop(doc_id) == want
        start += len(ids)
    assert not got


END = "<|endoftext|>"
WITH_ADDED = [
    f"a{END} x", END, END * 3, f" {END} ", f"a {END}", f"a  {END}  b", f"a\n{END}\nb", f"é{END}'s", f"<|endof{END}text|>", "<|endof", "text|>",
    f"日本{END}語\x85{END}", f"don't{END}'t {END}x{END}\n\n{END}", "<|endoftext|", f"{END}" + "word and word " * 500 + END,
]


def test_added_tokens_encode_as_the_unchanged_library_does():
    whole = Tokenizer.from_file(JSON)
    texts = WITH_ADDED + ODD
    own = token_shards.file_encoder(JSON, True)
    assert encoded(own, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(own, [WITH_ADDED[0]]) == [[64, 50256, 2124]]
    rng = np.random.default_rng(3)
    mixed = ["".join(rng.choice([END, " ", "\n", "a", "'s", "1", "<|", "|>", "é", "  ", ".", "日"], 12)) for _ in range(3000)]
    assert encoded(own, mixed) == [whole.encode(t, add_special_tokens=False).ids for t in mixed]


def test_registered_shards_hold_added_tokens(spark, documents, monkeypatch):
    rows = list(enumerate(WITH_ADDED))
    monkeypatch.setattr(queries, "table", lambda *_: documents(*rows))
    got = by_id(queries.QUERIES["op7_token_shards"][0](spark, "none"))
    whole, start = Tokenizer.from_file(JSON), 0
    for doc_id, text in rows:
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert got[doc_id] == dict(doc_id=doc_id, start=start, n_tokens=len(ids), ids_crc32=zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_no_documents_no_shards(spark, documents):
    out = shared_dir(spark, "shards")
    token_shards.write_shards(documents(), out, JSON)
    assert token_shards.read_shards(spark.read.parquet(out)).count() == 0
