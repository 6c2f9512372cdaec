"""A text longer than any chunk of work, among short ones, through every operator on texts."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from claimscan.llm import decontaminate, language_id, lm_scoring, minhash_dedup, packing, quality_crf, quality_rules, sharding

from . import brute

PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    long = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(50_000)}" + ".\n" * (k % 50 == 0) for k in range(900_000))
    assert len(long) > 5 << 20
    return {0: "a short text of some words that stands alone here", 1: long + " " + PASSAGE, 2: long + " other end of it", 3: PASSAGE, 4: None}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)


def test_dedup(texts, docs):
    rows = {r.doc_id: r for r in minhash_dedup.group(docs).collect()}
    assert {d: r.n_shingles for d, r in rows.items()} == {d: len(brute.shingles(t)) for d, t in texts.items()}
    assert {d: r.component_id for d, r in rows.items()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4}


def test_decontamination(spark, texts, docs):
    rows = {r.doc_id: r for r in decontaminate.find(docs, spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")).collect()}
    words = {d: len(brute.bench_words(t)) for d, t in texts.items()}
    assert {d: (r.n_words, r.n_hit, list(r["items"])) for d, r in rows.items()} == {d: (words[d], 12 if d in (1, 3) else 0, ["7"] if d in (1, 3) else []) for d in texts}


def test_packing(texts, docs):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    by = {}
    for r in packing.pack_documents(docs).collect():
        by.setdefault(r.doc_id, []).append(r)
    for d, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted(by[d], key=lambda r: r.piece)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
        assert sum(r.length for r in own) == len(ids) and all(r.length <= 1024 for r in own)


def test_language_and_quality(spark, texts, docs):
    models = language_id.fit(docs.selectExpr("'x' AS lang", "text").union(spark.createDataFrame([("y", "éàü ñß")], "lang string, text string")))
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, models).collect()}
    assert (got[1], got[2], got[4]) == ("x", "x", "und")
    chain = quality_crf.Chain(np.random.default_rng(1).normal(size=len(quality_crf.Chain().weights)))
    whole = {r.doc_id: r.score for r in quality_crf.score(docs, chain).collect()}
    alone = {d: quality_crf.score(docs.filter(f"doc_id = {d}"), chain).first().score for d in (0, 1)}
    assert all(whole[d] == pytest.approx(s) for d, s in alone.items()) and all(0 <= s <= 1 for s in whole.values())


def test_rules_and_shards(texts, docs):
    rows = {r.doc_id: r for r in quality_rules.measure(docs).collect()}
    assert {d: (r.n_words, r.word_chars) for d, r in rows.items()} == {d: (len((t or "").split()), len("".join((t or "").split()))) for d, t in texts.items()}
    assert sorted(r.slot for r in sharding.shard(docs, 1).collect()) == [0, 1, 2, 3, 4]


def test_language_model(texts, docs):
    rows = {r.doc_id: r for r in lm_scoring.score(docs, docs.doc_id >= 0).collect()}
    assert {d: r.n_tokens for d, r in rows.items()} == {d: len((t or "").split()) + 1 for d, t in texts.items()}
    assert all(r.n_known == r.n_tokens and r.score < 0 for r in rows.values())
    assert rows[1].bits_per_byte < rows[0].bits_per_byte  # its strings were seen twice
