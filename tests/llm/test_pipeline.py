"""The pipeline against a brute-force version of its stages, on the smallest tables."""

import random
import re
from pathlib import Path

import corpus_pipeline
from claimscan.llm import language_id, packing, quality_rules

from . import brute
from .test_packing import assert_packed, pieces_of

DATA = "/root/testdata/sf0.001"


def base_failed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(p for i in at for p in range(i, i + 5))
    return len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "minhash_dedup", "decontaminate", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}

    kept = quality_rules.stage(spark, docs, DATA)
    assert kept.columns == docs.columns
    failed = {d for d, r in rows.items() if base_failed(r.text)}
    hosts = {h for h in {r.source for r in rows.values()}}
    rate = {h: sum(d in failed for d, r in rows.items() if r.source == h) / sum(r.source == h for r in rows.values()) for h in hosts}
    want = {d for d, r in rows.items() if d not in failed}
    got = {r.doc_id for r in kept.collect()}
    assert got <= want and all(rate[rows[d].source] > 0.3 for d in want - got)

    known = language_id.stage(spark, kept, DATA)
    assert {tuple(r) for r in known.collect()} <= {tuple(r) for r in kept.collect()}
    left = {r.doc_id: r.text for r in known.collect()}
    assert len(left) > 0.9 * len(got)

    single = corpus_pipeline.STAGES[2][1](spark, known, DATA)
    root, _ = brute.components(list(left.items()))
    left = {d: t for d, t in left.items() if root[d] == d}
    assert {r.doc_id for r in single.collect()} == set(left)

    clean = corpus_pipeline.STAGES[3][1](spark, single, DATA)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hit = {d for d, (_, n, _) in brute.contamination(list(left.items()), items).items() if n}
    left = {d: t for d, t in left.items() if d not in hit}
    assert {r.doc_id for r in clean.collect()} == set(left)

    packed = corpus_pipeline.run(spark, DATA).collect()
    assert_packed(packed)
    want = {(d, i, *p) for d, ps in pieces_of(list(left.items())).items() for i, p in enumerate(ps)}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed} == want
    assert packing.CAPACITY == 1024


def test_edges(spark):
    docs = brute.edge_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0


def written(spark):
    """Bytes of the tables below the shared folder."""
    return sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*.parquet"))


def test_quality_stage_writes_no_documents(spark):
    """It returns what the operator keeps, and what it writes on the way is small beside the texts."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(400)) for _ in range(300)]
    rows = [(i, "few words" if 200 <= i < 290 else t, "a" if i < 200 else "b") for i, t in enumerate(texts)]
    rows += [(None, texts[0], None), (400, None, None), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    was = written(spark)
    got = quality_rules.stage(spark, docs, DATA)
    assert written(spark) - was < 0.05 * sum(len(t) for t in texts)
    key = lambda r: (r.doc_id is None, r.doc_id, r.text, r.source)
    want = quality_rules.judge(docs).collect()
    assert sum(r.host_failed and not r.base_failed for r in want) == 10
    assert sorted(map(key, got.collect())) == sorted(key(r) for r in want if r.kept)
