import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claimscan.llm import decontaminate as dc
from claimscan.llm import language_id as li
from claimscan.llm import minhash_dedup as md
from claimscan.llm import quality_rules as qr
from claimscan.llm import sharding as sh

from . import brute

DATA = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = li.op10_language_id(spark, DATA).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (brute.remainder(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("cells", [2, 6, 10, 1 << 22])
def test_long_texts_in_pieces(monkeypatch, cells):
    """Texts cut into pieces, with n-grams over their edges, add up to what whole texts give."""
    monkeypatch.setattr(li, "CELLS", cells)
    column = pa.array(["", "abc déf", None, "x", "12 !", "ßä ö q ab", "abcdefghijklmnop", "ab"])
    model = li.Model(["a", "b"], 16, np.random.default_rng(1).normal(size=((1 << 16) + 1, 2)), np.array([-0.5, -1.0]))
    model.matrix[-1] = 0
    got = li.log_probabilities(column, model)
    for t, text in enumerate(column.to_pylist()):
        chars, at = li.characters(pa.array([text]))
        want = model.prior + sum(model.matrix[li.buckets(chars, at, order, 16)].sum(axis=0) for order in li.ORDERS)
        assert got[t] == pytest.approx(want) if any(c.isalpha() for c in text or "") else (got[t] == -np.inf).all()


def test_language_edges(spark):
    docs = brute.edge_docs(spark)
    model = li.fit(docs)
    rows = li.predict(docs, model).collect()
    assert len(rows) == len(brute.EDGE_TEXTS) + 3
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id in (3, 8)} == {"en"}
    assert li.predict(brute.empty_docs(spark), model).collect() == []
    none = li.fit(brute.empty_docs(spark))
    assert {r.lang_pred for r in li.predict(docs, none).collect()} == {"und"}
    assert li.stage(spark, docs, DATA).columns == docs.columns


def plain_bayes(train, texts):
    """{text: (best language, its probability)} by dictionaries, one n-gram at a time."""
    mask = (1 << 32) - 1

    def grams(text):
        chars = [ord(x.lower()) if x.isalpha() and len(x.lower()) == 1 else ord(x) if x.isalpha() else 32 for x in text]
        for n in (1, 2, 3):
            for i in range(len(chars) - n + 1):
                h = n * 0x9E3779B1 & mask
                for c in chars[i : i + n]:
                    h = (h ^ c) * 0x85EBCA6B & mask
                    h ^= h >> 15
                yield (h * 0xC2B2AE35 & mask) >> 16

    seen, docs = {}, Counter(lang for _, lang in train)
    for text, lang in train:
        seen.setdefault(lang, Counter()).update(grams(text))
    size = {lang: sum(c.values()) + 0.5 * 65536 for lang, c in seen.items()}
    out = {}
    for text in texts:
        own = list(grams(text))
        log = {lang: math.log(docs[lang] / len(train)) + sum(math.log((seen[lang][g] + 0.5) / size[lang]) for g in own) for lang in sorted(seen)}
        best = max(log, key=log.get)
        out[text] = best, 1 / sum(math.exp(x - log[best]) for x in log.values())
    return out


@pytest.mark.parametrize("at_a_time", [li.MAX_LANGS, 3, 1])
def test_language_equals_plain_bayes(spark, at_a_time):
    """Whether the languages' matrices are sent at once or in several passes."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang IS NOT NULL").orderBy("doc_id").limit(60).collect()
    docs = spark.createDataFrame([(r.doc_id, r.text[:400], r.lang) for r in rows] + [(10**6, "Ünder the Straße", "xx"), (10**6 + 1, "123", "xx")], "doc_id long, text string, lang string")
    every = docs.collect()
    want = plain_bayes([(r.text, r.lang) for r in every], {r.text for r in every} - {"123"})
    models = li.fit(docs, at_a_time)
    assert all(len(m.langs) <= at_a_time for m in models) and sum(len(m.langs) for m in models) == len({r.lang for r in every})
    got = {r.doc_id: r for r in li.predict(docs, models).collect()}
    assert (got[10**6 + 1].lang_pred, got[10**6 + 1].score) == ("und", 0)
    for r in every:
        if r.text != "123":
            assert got[r.doc_id].lang_pred == want[r.text][0] and got[r.doc_id].score == pytest.approx(want[r.text][1], rel=1e-6)


CLASHES = ["host", "row", "document", "t", "w", "__w", "__host", *qr.RESULTS, "doc_key", "lang_pred", "score", "__best", "__top", "__sum", "n_shingles", "component_id", "n_hit", "items", "segment", "place", "repeated", "shingles", "c"]


def test_filter_stages_return_columns_untouched(spark):
    """Whatever the names of further columns; exact repeats of a row leave one, and rows without doc_id are judged by their texts."""
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 100").first().text
    good = "plain words of one more text that say this and that about some subject without any end number {} and so on"
    rows = [(i, good.format("one two three four five six seven eight nine ten".split()[i]) + f" {i} x{i} y{i} z{i}") for i in range(5)]
    rows += [rows[0], (None, rows[1][1]), (None, "words nobody else has in this small table of texts for a test of stages"), (None, f"before {bench} after"), (9, f"again {bench} behind it")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, *range(len(CLASHES))) for d, t in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"`{c}` int" for c in dict.fromkeys(CLASHES)]]))
    for f in (qr.stage, li.stage, md.stage, dc.stage):
        out = f(spark, docs, DATA)
        assert out.schema == docs.schema
        got = out.collect()
        assert all(tuple(r)[5:] == tuple(range(len(CLASHES))) for r in got)
        ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in got)
        if f is dc.stage:
            assert ids == [-1, -1, 0, 0, 1, 2, 3, 4]
        elif f is md.stage:
            assert {i: ids.count(i) for i in ids if i >= 0} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 9: 1} and sum(r.text == rows[1][1] for r in got) == 1
        else:
            assert len(got) == len(rows)


def test_quality_edges(spark):
    docs = brute.edge_docs(spark)
    rows = qr.judge(docs).collect()
    assert len(rows) == len(brute.EDGE_TEXTS) + 3
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[0].n_words == 0 and by[0].base_failed and not by[0].kept
    assert by[9].n_words == by[9].n_repeat_words == 3000 and by[9].base_failed
    assert by[7].word_chars == 5000
    assert qr.judge(brute.empty_docs(spark)).collect() == []
    assert qr.stage(spark, docs, DATA).columns == docs.columns


@pytest.mark.parametrize("text,n", [("a b c d e x a b c d e", 10), ("a a a a a a", 6), ("a b c d e", 0), ("a b c d a b c d a", 9), ("p q r s t u p q r s t u v p q r s t", 17)])
def test_repeated_words(spark, text, n):
    df = spark.createDataFrame([(text,)], "text string")
    assert qr.measure(df).first().n_repeat_words == n


def test_bad_host_takes_its_documents_along(spark):
    good, bad = "these are ten good words of one text number " , "x x x x x x x x x x x x "
    rows = [(i, good + str(i) + " y", "a") for i in range(50)] + [(100 + i, bad if i < 45 else good + str(i) + " y", "b") for i in range(50)] + [(200, good + "k y", None)]
    out = {r.doc_id: r for r in qr.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].kept and out[200].kept
    assert not out[149].kept and not out[149].base_failed and out[149].host_rate > 0.5


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 24, 25, 100])
def test_jump_hash(spark, n):
    keys = [*range(200), -1, 2**63 - 1, -(2**63), 123456789012345678]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert all(r.s == jump(r.k, n) for r in df.select("k", sh.jump_hash(df.k, n).alias("s")).collect())


def test_sharding_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = sh.op8_sharding(spark, DATA).collect()
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        assert r.shard == jump(r.doc_id, 24) and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0.5 / 25 < sum(r.grown_shard != r.shard for r in rows) / len(rows) < 2 / 25


def test_sharding_edges(spark):
    docs = brute.edge_docs(spark)
    rows = sh.shard(docs, 3).collect()
    assert len(rows) == len(brute.EDGE_TEXTS) + 3
    for s in range(3):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert sh.shard(brute.empty_docs(spark), 3).collect() == []
