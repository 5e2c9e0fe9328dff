"""The pipeline's rows, stage by stage, against plain Python."""

import collections
import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from telemill.llm import bpe, mixing, quality
from telemill.llm.shared import table

from .conftest import SF, by_id
from .test_near_dedup import LOWER, plain_components


def test_stages(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    state, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, SF).cache()
        kept[name] = collections.Counter(r.doc_id for r in state.collect())
        if name != "encoding":
            assert state.columns == docs.columns
    good = {i for i, r in by_id(quality.quality(docs)).items() if r["kept"]}
    assert set(kept["quality rules"]) == good and 0 < len(good) < len(texts)
    last = {}
    for i in sorted(good):
        last[texts[i].translate(LOWER)] = i
    assert set(kept["exact dedup"]) == set(last.values())
    groups = plain_components([(i, texts[i]) for i in kept["exact dedup"]])
    assert set(kept["near duplicates"]) == {i for i, (_, c) in groups.items() if i == c}
    near = docs.filter(docs.doc_id.isin(*kept["near duplicates"]))
    copies = {i: len(r["copies"]) for i, r in by_id(mixing.mix(near)).items() if r["copies"]}
    assert kept["mixing"] == copies == kept["encoding"]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in state.collect():
        assert row.ids == own.encode_ordinary(texts[row.doc_id]) and row.n_tokens == len(row.ids)


def test_run_takes_stages_in_order(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "near duplicates", "mixing", "encoding"]
    first = corpus_pipeline.run(spark, SF)
    assert first.columns == ["doc_id", "n_tokens", "ids"] and first.count() > 0
    digest = lambda df: hashlib.sha256(repr(sorted(map(repr, df.collect()))).encode()).hexdigest()
    assert digest(first) == digest(corpus_pipeline.run(spark, SF))
