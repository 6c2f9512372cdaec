import random

import numpy as np
import pytest

from claimscan.llm import minhash_dedup as md

from . import brute

DATA = "/root/testdata/sf0.01"


def run(spark, rows):
    out = md.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: r.component_id for r in out}, {r.doc_id: r.n_shingles for r in out}


def check(spark, rows):
    got, sizes = run(spark, rows)
    want, want_sizes = brute.components(rows)
    assert sizes == want_sizes
    assert got == want


def test_documents_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in md.op3_minhash_dedup(spark, DATA).collect()}
    want, sizes = brute.components(docs)
    assert got == {d: (want[d], sizes[d], want[d] == d) for d in want}
    assert any(d != c for d, c in want.items())


def test_chains_templates_and_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    base = [rng.choice(words) for _ in range(60)]
    for _ in range(40):  # a chain: each text differs a little from the one before
        base = base[:]
        base[rng.randrange(60)] = rng.choice(words)
        rows.append((len(rows), " ".join(base)))
    shared = [rng.choice(words) for _ in range(40)]
    for _ in range(80):  # one template, too different to be linked
        rows.append((len(rows), " ".join(shared + [rng.choice(words) for _ in range(14)])))
    for _ in range(60):  # near copies of one text
        own = shared[:] + base[:20]
        own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, rows[3][1]) for i in range(30)]
    rng.shuffle(rows)
    check(spark, rows)


def test_large_bucket_is_resolved_by_prefixes(spark, monkeypatch):
    monkeypatch.setattr(md, "SMALL_BUCKET", 0)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(50)]
        for _ in range(8):
            own = base[:]
            for _ in range(rng.randrange(4)):
                own[rng.randrange(50)] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    check(spark, rows)


def test_edges(spark):
    out = md.group(brute.edge_docs(spark)).collect()
    assert len(out) == len(brute.EDGE_TEXTS) + 3
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0
    assert by[6].component_id == 5 and by[0].component_id == 0 and by[1].component_id == 1
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert md.group(brute.empty_docs(spark)).collect() == []
    assert md.stage(spark, brute.edge_docs(spark), DATA).columns == brute.edge_docs(spark).columns


def test_signature_is_circulant():
    first, second = md.permutations()
    sh = np.array([5, 123456789, 2**63 + 11], dtype=np.uint64)
    table = second[:, 0]
    size = 1 << md.UNIVERSE_BITS
    want = [min(int(table[(int(first[int(x) % size]) + k) % size]) for x in sh) for k in range(md.BANDS * md.ROWS)]
    assert md.signature(sh).tolist() == want


@pytest.mark.parametrize("n", [4, 5, 6])
def test_shingles_of_short_texts(n):
    import pyarrow as pa

    (own,) = md.shingle_sets(pa.array([" ".join("abcdef"[:n])]))
    assert len(own) == max(1, n - 4)
