import hashlib
import random

from claimscan.llm import decontaminate as dc

from . import brute

DATA = "/root/testdata/sf0.01"


def test_documents_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = brute.contamination(docs, items)
    got = dc.op2_decontaminate(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.n_near >= r.n_items
    assert any(r.contaminated for r in got)


ITEMS = [(1, "A b c d e f g h i j k"), (10, "short one"), (2, None), (3, "!!"), (4, "a b c d e f g h i j k"), (5, "the the the the the the the the the the the")]
DOCS = [
    (1, "x A, b c d e f g h i j y a b c d e f g h i"),
    (2, "Short one, short ONE and one short"),
    (3, "the " * 15),
    (4, None),
    (5, "j i h g f e d c b a"),
    (6, ""),
    (7, "a b c d e"),
    (8, "f g h i j k"),
]


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_small_cases_and_slices(spark, monkeypatch):
    docs, items = frames(spark)
    want = brute.contamination(DOCS, ITEMS)
    for limit in (10**6, 12):
        monkeypatch.setattr(dc, "SLICE_WORDS", limit)
        monkeypatch.setattr(dc.slices, "__defaults__", (limit,))
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in dc.find(docs, items).collect()}
        assert got == want


def test_spans_and_proximity(spark):
    docs, items = frames(spark)
    got = {r.doc_id: r for r in dc.find(docs, items).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(1, 11)]
    assert [(s.start, s.end) for s in got[2].spans] == [(0, 4)]
    assert got[5]["items"] == [] and got[5].near_items == ["1", "4"]
    assert got[2].near_items == ["10"]
    assert got[7].near_items == [] and got[8].near_items == []


def test_proximity_equals_brute_force(spark):
    """All spans of 20 words tried one by one, single frequent words included."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))) for i in range(60)]
    items = [(i, " ".join(rng.choice("abcdefghi") for _ in range(rng.choice([1, 2, 5, 11])))) for i in range(30)]

    def windows(text):
        w = text.split()
        return [set(w[i : i + 10]) for i in range(max(1, len(w) - 9))] if w else []

    for r in dc.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        own = docs[r.doc_id][1].split()
        spans = [set(own[i : i + dc.SPAN]) for i in range(len(own))]
        assert list(r.near_items) == sorted(str(i) for i, t in items if any(w <= s for w in windows(t) for s in spans))


def test_repeated_rows_in_slices(spark, monkeypatch):
    """Several slices give the same rows as one, also for repeated, changed and missing doc_ids."""
    _, items = frames(spark)
    docs = spark.createDataFrame([*DOCS, DOCS[0], (1, DOCS[1][1]), (None, DOCS[0][1]), (None, "clean"), (None, None)], "doc_id long, text string")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, list(r["items"]), list(r.near_items))
    one = sorted(key(r) for r in dc.find(docs, items).collect())
    monkeypatch.setattr(dc.slices, "__defaults__", (12,))
    assert sorted(key(r) for r in dc.find(docs, items).collect()) == one
    assert len(one) == len(DOCS) + 5


def test_edges(spark):
    _, items = frames(spark)
    out = dc.find(brute.edge_docs(spark), items).collect()
    assert len(out) == len(brute.EDGE_TEXTS) + 3
    assert {r.n_hit > 0 for r in out if r.doc_id in (5, 6)} == {True}
    assert dc.find(brute.empty_docs(spark), items).collect() == []
    assert all(r.n_hit == 0 for r in dc.find(brute.edge_docs(spark), items.limit(0)).collect())
