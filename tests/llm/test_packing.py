import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from claimscan.llm import packing as pk

from . import brute

DATA = "/root/testdata/sf0.01"


def pieces_of(texts):
    tok = Tokenizer.from_file(pk.tokenizer_path())
    out = {}
    for d, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        n = -(-len(ids) // 1024)
        head = len(ids) - (n - 1) * 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        out[d] = [(a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def assert_packed(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = pieces_of(docs)
    rows = pk.op5_packing(spark, DATA).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert len(got.setdefault(r.doc_id, [])) == r.piece
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert got == want
    tokens = sum(r.length for r in rows)
    assert assert_packed(rows) <= 1.005 * -(-tokens // 1024) + 1


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_constraint_holds(score):
    rng = np.random.default_rng(3)
    histogram = {int(n): int(c) for n, c in zip(rng.integers(1, 101, 60), rng.integers(1, 40, 60), strict=True)}
    limits = pk.Limits(tokens=100, documents=5, attention=4000 if max(histogram) <= 63 else 10_000, score=score, weights=(1, 0.5, 0.5))
    bins, placed = {}, {}
    for length, r0, r1, copies, s0, o0 in pk.best_fit(histogram, limits):
        placed[length] = placed.get(length, 0) + r1 - r0
        for r in range(r1 - r0):
            bins.setdefault(s0 + r // copies, []).append((o0 + r % copies * length, length))
    assert placed == histogram
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 100
        assert len(own) <= 5 and sum(n * n for _, n in own) <= limits.attention


def test_all_residuals_choose():
    """Document count and attention cost move pieces to other sequences, but need no more of them."""
    rng = np.random.default_rng(8)
    histogram = {int(n): int(c) for n, c in zip(rng.integers(1, 1025, 700), rng.integers(1, 60, 700), strict=True)}
    plans = [pk.best_fit(histogram, pk.Limits(weights=w)) for w in ((1, 0, 0), (1, 0.5, 0.5), (1, 0, 2), (1, 2, 0))]
    used = [max(s0 + -(-(r1 - r0) // copies) for _, r0, r1, copies, s0, _ in p) for p in plans]
    assert plans[1] != plans[0] and plans[2] != plans[3] and max(used) <= 1.001 * used[0]
    assert all(w > 0 for w in pk.Limits().weights)


def test_edges(spark):
    rows = pk.pack_documents(brute.edge_docs(spark), with_ids=True).collect()
    assert_packed(rows)
    want = pieces_of(list(enumerate(brute.EDGE_TEXTS)))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.start, r.length, r.ids_crc32))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r.ids_crc32
    assert all(got[d] == set(w) for d, w in want.items())
    assert sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert pk.pack_documents(brute.empty_docs(spark)).collect() == []


def test_encoder_equals_tokenizer():
    import random

    import pyarrow as pa

    from claimscan.llm._bpe import Encoder

    random.seed(1)
    alphabet = "ab'sstremdvell  \n\t\r1²٣é中!?#  \x1c\x85_-"
    texts = [None, "", "don't we'll I'm 'tis ''s 're", "x<|endoftext|>y", "'", " '", "a'"] + ["".join(random.choice(alphabet) for _ in range(random.randrange(30))) for _ in range(5000)]
    tok = Tokenizer.from_file(pk.tokenizer_path())
    for part in (texts, texts[4:]):
        ids, at = Encoder(pk.tokenizer_path()).encode(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids, t
