import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claimscan.llm import lm_scoring as lm

from . import brute

DATA = "/root/testdata/sf0.01"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(brute.LOWER)), ""]


def base(docs):
    train = Counter(w for d, t in docs if d is not None and brute.remainder(d, 10) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    return n, {d: (len(w := tokens(t)), sum(train[x] > 0 for x in w), sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for d, t in docs}


def check_base(rows, docs):
    n, want = base(docs)
    for r in rows:
        if r.doc_id is not None:
            assert r.train_tokens == n and (r.n_tokens, r.n_known) == want[r.doc_id][:2]
            assert r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)


@pytest.mark.parametrize("head", [lm.HEAD_WORDS, 50])
def test_documents(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = lm.op9_lm_scoring(spark, DATA).collect()
    assert len(rows) == len(docs)
    check_base(rows, docs)
    assert all(r.held_out == (brute.remainder(r.doc_id, 10) == 0) for r in rows)
    held = [r for r in rows if r.held_out]  # two megabytes teach little yet; from 25 the model is better than the base
    assert sum(r.score for r in held) > 1.01 * sum(r.base_score for r in held)


def context_tree(train, test, depth):
    """The same probabilities by recursion over dictionaries of all contexts."""
    counts = {}
    for text in train:
        s = bytes([lm.END]) * depth + text.encode() + bytes([lm.END])
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for bit in range(8):
                    place = (s[i - d : i], (1 << bit) | (s[i] >> (8 - bit)))
                    counts.setdefault(place, [0, 0])[s[i] >> (7 - bit) & 1] += 1
    kids = {}
    for ctx, place in counts:
        if ctx:
            kids.setdefault((ctx[1:], place), set()).add(ctx)

    def kt(ab):
        return math.lgamma(ab[0] + 0.5) + math.lgamma(ab[1] + 0.5) - math.lgamma(sum(ab) + 1) - math.log(math.pi)

    weighted = {}

    def log_w(ctx, place):
        if (ctx, place) not in weighted:
            e = kt(counts[ctx, place])
            if len(ctx) < depth:
                e = float(np.logaddexp(e, sum(log_w(k, place) for k in kids[ctx, place]))) - math.log(2)
            weighted[ctx, place] = e
        return weighted[ctx, place]

    def one(s, i, d, place):
        """P(1) from depth d downwards."""
        ctx = s[i - d : i]
        ab = counts.get((ctx, place), [0, 0])
        own = (ab[1] + 0.5) / (sum(ab) + 1)
        if d == depth or (ctx, place) not in counts:
            return own
        stop = math.exp(kt(ab) - math.log(2) - log_w(ctx, place))
        return stop * own + (1 - stop) * one(s, i, d + 1, place)

    out = []
    for text in test:
        s = bytes([lm.END]) * depth + text.encode() + bytes([lm.END])
        total = 0.0
        for i in range(depth, len(s)):
            for bit in range(8):
                p = one(s, i, 0, (1 << bit) | (s[i] >> (8 - bit)))
                total += math.log10(p if s[i] >> (7 - bit) & 1 else 1 - p)
        out.append(total)
    return out


def test_packed_numbers_come_back():
    for values in (np.array([], np.int64), np.array([3, 4, 900, 1 << 47]), np.array([7, 0, 7], np.uint64), np.array([-1.5, 0.25], np.float32)):
        assert np.array_equal(lm.unpack(lm.pack(values), values.dtype.type), values)


def test_probabilities_of_the_next_byte_sum_to_one(spark):
    grams, n = np.unique(lm.distinct_grams(pa.RecordBatch.from_pydict({"text": ["the cat sat on the mat"] * 5}))[0], return_counts=True)
    context = int(grams[7]) >> 8
    every = np.unique(np.append(grams, (context << 8) | np.arange(256)))
    counts = np.zeros(len(every), np.uint64)
    counts[np.searchsorted(every, grams)] = n
    near, index = np.unique(every & 0xFFFFFF, return_inverse=True)
    top = lm.Top(near, np.bincount(index, weights=counts), *lm.Subtrees(every, counts).above())
    logp = lm.Subtrees(every, counts).log_probabilities(top)
    assert (10 ** logp[every >> 8 == context]).sum() == pytest.approx(1, abs=1e-5)


def test_edges(spark):
    docs = brute.edge_docs(spark)
    rows = lm.score(docs, docs.filter("doc_id IS NOT NULL")).collect()
    assert len(rows) == len(brute.EDGE_TEXTS) + 3
    empty = [r for r in rows if r.doc_id in (0, 1)]
    assert all(r.n_tokens == 1 and r.n_known == 1 and r.score == empty[0].score for r in empty)
    assert lm.score(brute.empty_docs(spark), docs).collect() == []
    none = lm.score(docs, brute.empty_docs(spark)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in none)


def test_score_is_the_whole_mixture_at_every_size(spark, monkeypatch):
    """The same whatever the number of parts, buckets and groups, and whether the training rows are a table or a condition."""
    train = ["abracadabra abracadabra", "a cad and a bra", "été", "", "abracadabra"] * 3
    test = ["abra cadabra", "", "zzz", "été à la bra", None]
    frame = lambda texts, at=0: spark.createDataFrame([(i + at, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    want = context_tree(train, [t or "" for t in test], lm.DEPTH)
    for part, buckets, group in ((1 << 24, 64, 1 << 24), (5, 3, 1 << 24), (5, 3, 200)):
        monkeypatch.setattr(lm, "PART", part)
        monkeypatch.setattr(lm, "LEAST_BUCKETS", buckets)
        monkeypatch.setattr(lm, "GROUP", group)
        rows = sorted(lm.score(frame(test), frame(train)).collect())
        assert [r.score for r in rows] == pytest.approx(want, rel=1e-5)
        assert [r.bits_per_byte for r in rows] == pytest.approx([-w / math.log10(2) / (len((t or "").encode()) + 1) for w, t in zip(want, test)], rel=1e-5)
        both = sorted(lm.score(frame(test).union(frame(train, 100)), lm.F.col("doc_id") >= 100).collect())
        assert [r.score for r in both[: len(test)]] == pytest.approx(want, rel=1e-5)
