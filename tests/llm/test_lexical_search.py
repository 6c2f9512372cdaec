"""Ranked search against a plain version that scores every document."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from claimscan.llm import lexical_search as x
from claimscan.llm._work import stash

from .brute import EDGE_TEXTS, LOWER, edge_docs, empty_docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """Sorted (item_id, rank, doc_id, score) of (doc_id, text) and (item_id, text)."""
    tf = [(d, Counter(terms(t))) for d, t in docs]
    tf = [(d, c) for d, c in tf if c]
    n, total, df = len(tf), sum(sum(c.values()) for _, c in tf), Counter(t for _, c in tf for t in c)
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for i, own in asked.items():
        scores = []
        for d, c in tf:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, y[3], -y[0]) for r, y in enumerate(sorted(scores, key=lambda y: y[:3])[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def index(spark, docs):
    return stash(x.build_index(spark.createDataFrame(docs, "doc_id long, text string")), "index")


def words(n, seed, of=300):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(i)}" for i in rng.zipf(1.3, n) % of)


@pytest.mark.parametrize("segment", [2000, 1 << 23])
def test_equals_plain_version(spark, monkeypatch, segment):
    docs = [(i, words(5 + i % 90, i)) for i in range(700)]
    docs += [(1000 + i, docs[i % 5][1]) for i in range(40)]  # equal scores
    items = [(i, words(3 + i % 30, 10_000 + i)) for i in range(60)] + [(900, docs[3][1]), (901, "unknown words only"), (902, None), (903, "")]
    items += [(5, "w1 w2 w3 w4")]  # a second row of item 5
    monkeypatch.setattr(x, "SEGMENT", segment)
    monkeypatch.setattr(x, "BLOCK", 16)
    built = index(spark, docs)
    monkeypatch.undo()
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows(x.search(built, asked)) == plain(docs, items)
    assert rows(x.search(built, asked, k=3)) == plain(docs, items, 3)


def test_blocks_are_joined_by_shuffle_beyond_the_limit(spark, monkeypatch):
    docs = [(i, words(20, i)) for i in range(200)]
    items = [(i, words(9, 77 + i)) for i in range(40)]
    monkeypatch.setattr(x, "BLOCK", 4)
    monkeypatch.setattr(x, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(x, "BROADCAST_TERMS", 0)
    assert rows(x.search(index(spark, docs), spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


def test_edge_cases(spark):
    docs = edge_docs(spark)
    plain_docs = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(None, "row with words"), (None, "lost"), (50, "ONE c's é été one")]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    built = stash(x.build_index(docs), "index")
    assert rows(x.search(built, asked)) == plain(plain_docs, items)
    assert rows(x.search(stash(x.build_index(empty_docs(spark)), "index"), asked)) == []
    assert rows(x.search(built, asked.limit(0))) == []


def test_names_as_item_ids(spark):
    docs = [(1, "a b c"), (2, "c d")]
    items = spark.createDataFrame([("x", "c"), ("y", "a d")], "item_id string, text string")
    assert rows(x.search(index(spark, docs), items)) == plain(docs, [("x", "c"), ("y", "a d")])


def test_best_positions_jump_and_end_the_search_early():
    """Of two long lists with the same first documents, a few accesses suffice; an equal score must not end the search."""
    n = 20_000
    row = {
        "lengths": np.full(n, 10), "terms": np.array([1, 2]), "dfs": np.array([n, n]), "docs": np.tile(np.arange(n, dtype=np.int32), 2),
        "tfs": np.concatenate([np.where(np.arange(n) < 20, 50 - np.arange(n), 1), np.where(np.arange(n) < 20, 30 + np.arange(n), 1)]).astype(np.int32),
    }
    lists = x.Lists(row, np.array([1, 2]), n, 10 * n)
    seen = []

    class Counting(x.Top):
        def add(self, scores, rows_):
            seen.extend(rows_.tolist())
            super().add(scores, rows_)

    top = Counting(10).within(np.arange(n), np.zeros(n, dtype=bool))
    lists.best(np.array([0, 1]), np.array([5, 7]), top)
    assert len(seen) == len(set(seen)) < 100
    dense = sum(w * lists.impact[i * n : (i + 1) * n] for i, w in enumerate((5, 7)))
    assert top.ids.tolist() == np.lexsort((np.arange(n), -dense))[:10].tolist()
    # all scores alike: every document must be read, and the least ids win
    row["tfs"] = np.ones(2 * n, np.int32)
    top = x.Top(10).within(np.arange(n)[::-1].copy(), np.zeros(n, dtype=bool))
    x.Lists(row, np.array([1, 2]), n, 10 * n).best(np.array([0, 1]), np.array([5, 7]), top)
    assert top.ids.tolist() == list(range(10))


def test_a_task_holds_a_segment_and_not_a_file_of_them(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(x, "SEGMENT", 2000)
    made = []
    monkeypatch.setattr(x, "stash", lambda df, name, **how: made.append(stash(df, name, **how)) or made[-1])
    spark.createDataFrame([(i, words(40, i)) for i in range(300)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w1 w2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert x.op13_lexical_search(spark, str(tmp_path)).count() == 10
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in made[0].inputFiles()]
    groups = [m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)]
    assert set(groups) == {1} and len(groups) > len(files)
