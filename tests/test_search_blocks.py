"""Blocks of queries and topics, the index that lives on, cells, closure under changes, buckets and state, against plain versions."""

import os
from glob import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from claimscan.functions.work import stash
from claimscan.operators import graph, memory, scan, search
from claimscan.operators.index import Index
from claimscan.plans.review import review
from claimscan.sources.buckets import BucketedTable
from claimscan.streaming import jobs, state


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- blocks ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("blocks", [64, 0])
def test_vector_topk_in_blocks(spark, monkeypatch, blocks):
    rng = np.random.default_rng(5)
    v, q = unit(rng.normal(size=(150, 8))), unit(rng.normal(size=(40, 8)))
    v[100:] = v[:50]  # ties
    corpus = spark.createDataFrame([*((f"k{i}", v[i].tolist()) for i in range(150)), ("bad", [1.0]), ("none", None)], "key string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([*((i, q[i].tolist()) for i in range(40)), (99, None), (98, [1.0])], "query_id long, embedding array<double>")
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "PACK", 16)
    monkeypatch.setattr(search, "HELD", 100)
    monkeypatch.setattr(search, "BROADCAST_BLOCKS", blocks)
    got = {(r.query_id, r["rank"]): (r.key, r.score) for r in search.vector_topk(asked, corpus, 4).collect()}
    s = q @ v.T
    for i in range(40):
        want = sorted(range(150), key=lambda j: (-s[i, j], f"k{j}"))[:4]
        assert [got[i, n + 1][1] for n in range(4)] == pytest.approx([s[i, j] for j in want])
        assert {got[i, n + 1][0] for n in range(4)} <= {f"k{j}" for j in range(150) if s[i, j] >= s[i, want[-1]] - 1e-12}
    assert got[98, 1] == ("bad", 1.0) and len(got) == 161


def groups_of(files):
    """Rows in each row group of Parquet files."""
    read = [pq.ParquetFile(f).metadata for f in files]
    return [m.row_group(g).num_rows for m in read for g in range(m.num_row_groups)]


def test_a_task_holds_a_segment_and_not_a_file_of_them(spark, monkeypatch, tmp_path):
    assert search.SEGMENT <= 1_000_000  # characters
    monkeypatch.setattr(search, "SEGMENT", 400)
    corpus = spark.createDataFrame([(f"k{i}", f"some text number {i} of many words", "a", "b") for i in range(200)], "key string, value string, source string, tags string").coalesce(2)
    index = Index.create(corpus, str(tmp_path))
    index.upsert(corpus.filter("key LIKE 'k1%'"))
    for files in (glob(f"{tmp_path}/segments-*/*.parquet"), [f.removeprefix("file:") for f in search.build_index(corpus).inputFiles()]):
        assert len(files) >= 2 and set(groups_of(files)) == {1} and len(groups_of(files)) > 10


def test_no_query_passes_through_the_driver():
    folder = os.path.dirname(search.__file__)
    assert not any("toLocalIterator" in open(f"{folder}/{n}.py").read() for n in ("search", "memory", "index"))


@pytest.mark.parametrize("blocks", [64, 0])
def test_match_topics_in_blocks(spark, monkeypatch, blocks):
    rng = np.random.default_rng(6)
    v, c = unit(rng.normal(size=(60, 6))), unit(rng.normal(size=(25, 6)))
    c[20:] = c[:5]  # ties go to the lowest id
    df = spark.createDataFrame([(i % 50, v[i].tolist()) for i in range(60)], "key long, embedding array<double>").repartition(3)
    topics = spark.createDataFrame([(24 - i, c[i].tolist()) for i in range(25)], "id long, centroid array<double>")
    monkeypatch.setattr(memory, "TOPIC_BLOCK", 4)
    monkeypatch.setattr(memory, "PACK", 8)
    monkeypatch.setattr(memory, "BROADCAST_BLOCKS", blocks)
    s = np.round(v @ c[::-1].T, 9)  # column = id
    want = [(i % 50, int(s[i].argmax()) if s[i].max() >= 0.5 else None, round(float(max(s[i].max(), 0)), 6)) for i in range(60)]
    got = memory.match_topics(df, topics, 0.5).withColumn("similarity", F.round("similarity", 6))
    assert rows(got) == sorted(want, key=repr)
    assert {tuple(r)[1:] for r in memory.match_topics(df, topics.limit(0)).collect()} == {(None, 0.0)}


# --- cells ----------------------------------------------------------------------------------------


def near_copies(n, rng, dim=64):
    x = unit(rng.normal(size=(n // 2, dim)))
    return np.concatenate([x, memory._moved(x, 0.88, rng)])


def test_work_of_cells_grows_slower_than_all_pairs():
    rng, met, recall = np.random.default_rng(1), [], []
    for n in (4000, 16000, 64000):
        v = near_copies(n, rng)
        code = memory.choose_cells(v[rng.permutation(n)], n, 0.85, 0.95).of(v)
        met.append(sum(int((np.unique(c, return_counts=True)[1] ** 2).sum()) // 2 for c in code.T))
        recall.append((code[: n // 2] == code[n // 2 :]).any(axis=1).mean())
    assert min(recall) >= 0.9
    assert met[2] < 2.3**4 * met[0]  # four doublings; all pairs would be 4 ** 4
    assert met[2] < 0.01 * 64000**2 / 2


def test_pruned_pairs_by_cells(spark):
    v = near_copies(2400, np.random.default_rng(2), 32)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(len(v))], "key long, embedding array<double>")
    exact = {(r.key, r.other) for r in memory.similar_pairs(df, 0.85).collect()}
    found = {(r.key, r.other) for r in memory.similar_pairs_pruned(df, 0.85, size=32, block=20).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact)
    assert memory.choose_cells(v, 2400, 0.2, 0.95) is None  # all pairs are less work


@pytest.mark.parametrize("pairs", [memory.similar_pairs, memory.similar_pairs_pruned])
def test_pairs_of_new_rows_only(spark, pairs):
    v = near_copies(1200, np.random.default_rng(3), 32)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(len(v))], "key long, embedding array<double>")
    old, new = df.filter("key % 3 > 0"), df.filter("key % 3 = 0")
    every = {(r.key, r.other): r.strength for r in memory.similar_pairs(df, 0.85).collect()}
    want = {k for k in every if k[0] % 3 == 0 or k[1] % 3 == 0}
    got = {(r.key, r.other) for r in pairs(old, 0.85, new=new).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 100


# --- centroids, short words -----------------------------------------------------------------------


def test_centroids_from_merged_sums(spark):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(80)], "key long, embedding array<double>")
    members = v.select((F.col("key") % 7).alias("topic_id"), "key").union(v.filter("key < 9").select(F.lit(None).cast("long"), "key"))
    whole = {r.topic_id: r.centroid for r in memory.recalculate_centroids(members, v).collect()}
    parts = [memory.topic_sums(members.filter(f), v) for f in ("key < 50", "key >= 50")]
    merged = {r.topic_id: r.centroid for r in memory.centroids_of(memory.merge_sums(*parts)).collect()}
    assert set(whole) == set(merged) == {*range(7), None}
    for t in whole:
        assert merged[t] == pytest.approx(whole[t])
    assert all(np.linalg.norm(r.centroid) == pytest.approx(1) for r in memory.recalculate_centroids(members, v, True).collect())


def test_many_short_words(spark):
    words = spark.range(120_000).select(F.decode(F.unhex(F.concat(F.hex(F.col("id") % 400 + 0x4E00), F.hex(F.floor(F.col("id") / 400) + 0x5E00))), "UTF-16BE").alias("word"), F.lit("confirm").alias("action"), F.lit(1).cast("long").alias("at"))
    m = spark.createDataFrame([("a", chr(0x4E00) + chr(0x5E00) + " x"), ("b", "X" + chr(0x4E01) + chr(0x5E02)), ("c", None), ("d", "")], "key string, value string")
    more = spark.createDataFrame([("x", "dismiss", 2), ("x ", "other", 3)], "word string, action string, at long")
    got = sorted((r.key, r.delta) for r in memory.deltas_from_feedback(words.unionByName(more), m).collect())
    assert got == [("a", -0.1), ("a", 0.05), ("b", -0.1), ("b", 0.05)]


# --- index ----------------------------------------------------------------------------------------


def corpus(spark, texts):
    return spark.createDataFrame([(f"k{i}", t, "s", "a,b") for i, t in texts.items()], "key string, value string, source string, tags string")


def test_index_equals_a_rebuild_after_each_change(spark, monkeypatch):
    monkeypatch.setattr(search, "SEGMENT", 400)
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"word{int(i)}" for i in rng.integers(0, 30, 6))
    texts = {i: text() for i in range(60)}
    asked = spark.createDataFrame([(i, text()) for i in range(8)] + [(8, "word1"), (9, "word2 word3")], "query_id long, text string")
    index = Index.create(corpus(spark, texts))

    def same(modes=("terms",)):
        fresh = search.build_index(corpus(spark, texts))
        for mode in modes:
            want = search.fulltext_topk(asked, k=5, mode=mode, index=fresh).withColumn("score", F.round("score", 8))
            got = search.fulltext_topk(asked, k=5, mode=mode, index=Index.open(spark, index.path).segments()).withColumn("score", F.round("score", 8))
            assert rows(want) == rows(got)

    changed = {i: text() for i in (3, 4, 70, 71)}
    texts |= changed
    index.upsert(corpus(spark, changed))
    same()
    index.delete(corpus(spark, {i: "" for i in (3, 5, 99)}).select("key"))
    texts = {i: t for i, t in texts.items() if i not in (3, 5)}
    same()
    same(["phrase"])
    assert index.merge(0.01, 0) > 0
    same()
    index.merge()
    changed = {70: "word1 word1"}
    texts |= changed
    index.upsert(corpus(spark, changed))
    same(["terms", "phrase"])


def test_a_change_writes_what_changed_only(spark):
    texts = {i: f"some words of text number {i} " * 20 for i in range(400)}
    index = Index.create(corpus(spark, texts))
    postings = lambda f: spark.read.parquet(f).select(F.sum(F.size("rows"))).first()[0]
    first = index._folders("segments")[0]
    times = {n: os.path.getmtime(f"{first}/{n}") for n in os.listdir(first)}
    index.upsert(corpus(spark, {i: "new text" for i in range(4)}))
    assert {n: os.path.getmtime(f"{first}/{n}") for n in os.listdir(first)} == times
    assert postings(index._folders("segments")[1]) < 0.01 * postings(first)
    hits = search.fulltext_topk(spark.createDataFrame([(1, "some")], "query_id long, text string"), k=1000, index=index.segments())
    assert hits.count() == 396


# --- closure --------------------------------------------------------------------------------------


def test_closure_under_batches_of_changes(spark):
    rng = np.random.default_rng(9)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 24, (30, 2)) if a != b}
    table = lambda e: spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in e], "from_id string, to_id string")
    closure = stash(graph.transitive_closure(table(edges)), "closure")
    for turn in range(2):
        new = {(int(a), int(b)) for a, b in rng.integers(0, 28, (6, 2)) if a != b} - edges
        edges |= new
        closure = stash(graph.add_edges(closure, table(new)), "closure")
        assert rows(closure) == rows(graph.transitive_closure(table(edges))), turn
        gone = set(sorted(edges)[turn :: 6])
        edges -= gone
        closure = stash(graph.remove_edges(closure, table(gone), table(edges)), "closure")
        assert rows(closure) == rows(graph.transitive_closure(table(edges))), turn


# --- dictionary -----------------------------------------------------------------------------------


def test_automaton_equals_regular_expressions():
    import random
    import re

    rng, letters = random.Random(1), "aAbBsSſKkiIİıßẞ µμé É."
    for _ in range(400):
        word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 3)))
        patterns = [re.escape(word()) if rng.random() < 0.7 else rng.choice(["a+", "(a|b)", "[ab]s", r"s\b", "(?i:k)"]) for _ in range(rng.randint(1, 6))]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 25)))
        assert scan.Dictionary(patterns).matches(text) == [(n, *m.span()) for n, p in enumerate(patterns) for m in re.compile(p, re.IGNORECASE).finditer(text)]


def test_many_literal_rules(spark):
    n = 20_000
    rules = spark.range(n).select(F.col("id").cast("int").alias("rule_idx"), F.concat(F.lit("w"), F.col("id")).alias("word"), F.concat(F.lit("w"), F.col("id"), F.lit("x")).alias("pattern"), F.lit("c").alias("category"), F.lit("r").alias("regulation_ref"))
    docs = spark.createDataFrame([(1, "W7x and w19999X w20000x"), (2, "none"), (3, None)], "doc_id long, text string")
    assert rows(scan.scan_terms(docs, rules).select("doc_id", "rule_idx", "word")) == [(1, 19999, "w19999X"), (1, 7, "W7x")]
    assert {r.doc_id: r.flagged for r in scan.flag_documents(docs, rules).collect()} == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("most", [100_000, 0])
def test_notes_of_many_words(spark, monkeypatch, most):
    monkeypatch.setattr(scan, "MAX_NOTES", most)
    rules = spark.createDataFrame([(0, "best", "best", "极限用语", "r"), (1, "cheap", "cheap", "其他", "r")], "rule_idx int, word string, pattern string, category string, regulation_ref string")
    docs = spark.createDataFrame([(1, "best and cheap best"), (2, "nothing"), (3, None), (1, "best and cheap best")], "doc_id long, text string")
    words = spark.range(300 if most else 200_000).select(F.concat(F.lit("w"), "id").alias("word"), F.lit("confirm").alias("action"))
    feedback = words.union(spark.createDataFrame([("best", "dismiss")] * 20 + [("cheap", "confirm")] * 20, "word string, action string"))
    replacements = spark.createDataFrame([("cheap", ["fair"])], "prohibited string, alternatives array<string>")
    got = review(docs, rules, replacements, feedback=feedback).select("doc_id", "n_hits", F.to_json("violations"))
    monkeypatch.setattr(scan, "MAX_NOTES", 1_000_000)
    assert rows(got) == rows(review(docs, rules, replacements, feedback=feedback.filter("word IN ('best', 'cheap')")).select("doc_id", "n_hits", F.to_json("violations")))


# --- buckets and state ----------------------------------------------------------------------------


def test_upsert_writes_touched_buckets_only(spark):
    base = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("old").alias("value"), F.lit(1).cast("long").alias("updated_at"))
    table = BucketedTable.create(base, "key", 16)
    before = dict(table.folders)
    times = lambda folders: {f: sorted(os.path.getmtime(f"{f}/{n}") for n in os.listdir(f)) for f in folders}
    was = times(before.values())
    new = spark.createDataFrame([("k7", "new", 2), ("k7", "newer", 3), ("x", "added", 2), (None, "lost", 2)], "key string, value string, updated_at long")
    touched = table.upsert(new, tag="one")
    assert 1 <= len(touched) <= 2
    assert times(before.values()) == was
    assert {b for b in before if table.folders[b] != before[b]} <= set(touched)
    again = BucketedTable.open(spark, table.path)
    assert again.upsert(new, tag="one") == []  # the same change again
    got = {r.key: r.value for r in again.read().collect()}
    assert len(got) == 501 and got["k7"] == "newer" and got["x"] == "added" and got["k8"] == "old"


def in_order(spark, batches, schema, folder):
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{folder}/f{n:03}")
        for f in os.listdir(f"{folder}/f{n:03}"):
            os.utime(f"{folder}/f{n:03}/{f}", (1_700_000_000 + n * 60, 1_700_000_000 + n * 60))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_state_fold_equals_batch_fold(spark, tmp_path):
    state.use_rocksdb(spark)
    rng = np.random.default_rng(10)
    batches = [[(f"k{int(rng.integers(3))}", 100 * b + int(rng.integers(0, 160)), float(rng.choice([0.4, -0.5, 0.1])), "r") for _ in range(12)] for b in range(4)]
    batches += [[("end", 100_000, 0.0, "")], [("end", 200_000, 0.0, "")]]
    stream = in_order(spark, batches, "key string, t long, delta double, reason string", tmp_path / "in").withColumn("at", F.timestamp_seconds("t"))
    log = jobs.run_to_end(state.fold_deltas(stream, "5 minutes"), "log").filter("key != 'end'")
    deltas = spark.createDataFrame([r for b in batches for r in b], "key string, t long, delta double, reason string").withColumn("at", F.timestamp_seconds("t"))
    known = deltas.filter("key != 'end'").select("key").distinct().withColumn("confidence", F.lit(None).cast("double"))
    shown = ["key", "step", F.round("old_confidence", 9), F.round("new_confidence", 9), "delta", "at"]
    assert rows(log.select(*shown)) == rows(memory.apply_confidence(known, deltas).select(*shown))


def test_state_keeps_the_last_row(spark, tmp_path):
    state.use_rocksdb(spark)
    batches = [[("a", 1, "x"), ("b", 5, "y"), ("a", 3, "z")], [("a", 2, "late"), ("c", 1, None)], [("b", 6, "w"), ("b", 6, "v")]]
    stream = in_order(spark, batches, "key string, at long, value string", tmp_path / "in")
    table = BucketedTable.create(spark.createDataFrame([], "key string, at long, value string"), "key", 4)
    seen = []
    sink = jobs.table_sink(table, "at")
    jobs.run_to_end(state.keep_last(stream, "key", "at"), "last", "update", lambda b, n: (seen.append(sorted(r.key for r in b.collect())), sink(b, n)))
    assert [s for s in seen if s] == [["a", "b"], ["c"], ["b"]]
    assert rows(table.read()) == [("a", 3, "z"), ("b", 6, "w"), ("c", 1, None)]


def test_table_fold_equals_the_whole_state_fold(spark, tmp_path):
    m = spark.createDataFrame([("k1", "aa here", 0.5), ("k2", "bb aa", None), ("k3", "none", 0.3)], "key string, value string, confidence double")
    batches = [[("aa", "confirm", 1)], [("aa", "dismiss", 2)], [("bb", "confirm", 3)], [("aa", "confirm", 4), ("none", "dismiss", 5)]]
    stream = in_order(spark, batches, "word string, action string, at long", tmp_path / "in")
    table = BucketedTable.create(m, "key", 4)
    jobs.run_to_end(stream, "feedback", batch=jobs.confidence_sink(table, Index.create(m, names=("value",)).segments()))
    got = {r.key: r.confidence for r in table.read().collect()}
    assert got == {"k1": pytest.approx(0.5), "k2": pytest.approx(0.55), "k3": pytest.approx(0.2)}


@pytest.mark.parametrize("known", [100_000, 3])
def test_functions_of_feedback_equal_the_log(spark, monkeypatch, known):
    monkeypatch.setattr(memory, "KNOWN", known)
    monkeypatch.setattr(memory, "PART", 40)
    monkeypatch.setattr(memory, "FIRST", 5)
    rng = np.random.default_rng(12)
    m = spark.createDataFrame([(f"k{i:02}", f"{i} and long word{i % 4}", None if i % 3 == 0 else i / 40) for i in range(40)], "key string, value string, confidence double")
    rare = ["39", "7", "1", "word2", "WORD3", "nowhere", ""]
    f = spark.createDataFrame([(rare[int(rng.integers(7))], ["confirm", "dismiss", "modify"][int(rng.integers(3))], int(rng.integers(60))) for _ in range(400)], "word string, action string, at long")
    want = {r.key: r.confidence for r in memory.new_confidences(memory.apply_confidence(m, memory.deltas_from_feedback(f, m, 4))).collect()}
    made = memory.feedback_functions(f, m, 4)
    assert made.count() == len(want) > 5  # a row a memory, however much feedback there is
    after = {r.key: r.confidence for r in memory.after_functions(m, made).collect()}
    assert len(after) == 40 and all(after[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert all(after[r.key] == r.confidence for r in m.collect() if r.key not in want)


@pytest.mark.parametrize("blocks", [64, 0])
def test_fused_vectors_equal_fused_scores(spark, monkeypatch, blocks):
    rng = np.random.default_rng(13)
    v, q = unit(rng.normal(size=(120, 6))), unit(rng.normal(size=(20, 6)))
    v[100:] = v[:20]  # ties
    corpus = spark.createDataFrame([*((i, v[i].tolist(), i % 4) for i in range(120)), (500, [1.0], 1), (501, None, 1)], "key long, embedding array<double>, label int").repartition(4)
    asked = spark.createDataFrame([*((i, q[i].tolist()) for i in range(20)), (98, [1.0]), (99, None)], "query_id long, embedding array<double>")
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "PACK", 16)
    monkeypatch.setattr(search, "BROADCAST_BLOCKS", blocks)
    every = search.vector_topk(asked, corpus, 200)
    conf = every.filter("key % 3 = 0").select("query_id", "key", (F.pmod(F.col("key") * 7 + F.col("query_id"), F.lit(11)) / 10.0).alias("norm"))
    parts = {"vec": search.minmax(every, "score", "query_id").select("query_id", "key", "norm"), "conf": conf}
    want = search.fuse_scores(parts, {"vec": 0.5, "conf": 0.2}, 5, corpus.filter("label IN (1, 2)"))
    got = search.fuse_vectors(asked, corpus, 0.5, 5, {"conf": (0.2, lambda q, key: np.where(key % 3 == 0, (key * 7 + q[:, None]) % 11 / 10.0, np.nan))}, F.col("label").isin(1, 2))
    shown = ["query_id", "key", F.round("score", 10), "rank"]
    assert rows(got.select(*shown)) == rows(want.select(*shown)) and got.count() == 101
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan or blocks == 0 or "BroadcastHashJoin" in plan


@pytest.mark.parametrize("block", [7, 4096])
def test_similar_pairs_shuffle_no_vector_twice(spark, block):
    rng = np.random.default_rng(14)
    v = unit(rng.normal(size=(90, 5)))
    v[80:] = v[:10]
    df = spark.createDataFrame([(f"k{i % 85}" if i else None, v[i].tolist()) for i in range(90)] + [("bad", [1.0])], "key string, embedding array<double>")
    pairs = memory.similar_pairs(df, 0.6, block)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    keys = [f"k{i % 85}" if i else None for i in range(90)]
    want = sorted(((keys[i], keys[j], round(float(v[i] @ v[j]), 9)) for i in range(90) for j in range(90) if keys[i] != keys[j] and v[i] @ v[j] >= 0.6), key=repr)
    assert sorted(((r.key, r.other, round(r.strength, 9)) for r in pairs.collect()), key=repr) == want
