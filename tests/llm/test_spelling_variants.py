"""Spelling variants against a plain version that compares all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np

from claimscan.llm import spelling_variants as m
from claimscan.llm._work import stash

from .brute import LOWER, edge_docs, empty_docs


def plain_words(docs, least=2):
    total = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += len(run) >= 7
    return {w: n for w, n in total.items() if n >= least}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, times=10):
    near = {w: [v for v in words if v != w and is_near(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        if own:
            best = min(own, key=lambda v: (-words[v], v))
            if words[best] >= times * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, words):
    return stash(spark.createDataFrame(list(words.items()), "word string, n long"), "words")


def test_variants_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    letters = list("abcé")
    base = ["".join(rng.choice(letters, rng.integers(7, 10))) for _ in range(60)]
    words = {}
    for w in base:
        words[w] = int(10 ** rng.uniform(0.5, 4))
        for _ in range(12):
            i, c = int(rng.integers(len(w))), str(rng.choice(letters))
            v = [w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c][int(rng.integers(4))]
            words.setdefault(v, int(rng.integers(2, 60)))
    assert rows(m.variants(table(spark, words))) == plain(words)
    assert rows(m.variants(table(spark, words), 2)) == plain(words, 2)


def test_equal_letters_ties_and_ends(spark):
    words = {"aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaaaaa": 500, "baaaaaaa": 50, "aaaaaaab": 50, "aaabaaaa": 50, "abcdefg": 2, "bcdefgh": 2, "xabcdefg": 20, "abcdefgx": 20, "ÿbcdefg": 20, "ab": 7, "a": 70}
    assert rows(m.variants(table(spark, words))) == plain(words)


def test_chain_of_forms_leads_to_one_root(spark):
    words = {"abcdefg" + "z" * i: 2 * 10**i for i in range(9)}
    got = rows(m.variants(table(spark, words)))
    assert got == plain(words)
    assert {r[2] for r in got} == {"abcdefgzzzzzzzz"}


def test_runs_across_batches(spark):
    words = {"abcdef" + chr(97 + i) + "xyz": i + 2 for i in range(26)} | {"abcdefxyz": 900, "unrelated": 3}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert rows(m.variants(table(spark, words))) == plain(words)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_counts_equal_plain_version(spark, monkeypatch):
    monkeypatch.setattr(m, "HELD", 5)
    texts = ["Straße Überraschung ÜBERRASCHUNG überraschung", "naïveté-naïveté×naïveté÷x naïveté", "l'Éléphant éléphant ÉLÉPHANT elephant_elephant9elephant", "abcdefghij " * 400, None, "", "short ones only", "漢字abcdefg漢abcdefgh"]
    docs = [(i, t) for i in range(40) for t in texts] + [(None, "abcdefghij no idabcdefg")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: r.n for r in m.count_words(df).collect()}
    assert got == plain_words(docs)
    assert {r.word: r.n for r in m.count_words(df, 50).collect()} == plain_words(docs, 50)


def test_whole_query_and_edge_cases(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    got = m.op11_spelling_variants(spark, "/root/testdata/sf0.001").collect()
    assert {r.word: r.n for r in got} == words
    few = dict(list(sorted(words.items()))[:400])
    assert rows(m.variants(table(spark, few))) == plain(few)
    edge = edge_docs(spark)
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    want = plain(plain_words([(r.doc_id, r.text) for r in edge.collect()]))
    assert rows(m.op11_spelling_variants(spark, str(tmp_path))) == want
    assert m.variants(stash(m.count_words(empty_docs(spark)), "words")).count() == 0


def test_no_run_is_longer_than_the_alphabet_and_one(spark):
    words = {"abc" + chr(97 + i) + "defg": 1 for i in range(26)} | {"abcdefg": 1}
    sizes = m.rotations(table(spark, words)).groupBy("key").count()
    assert sizes.agg({"count": "max"}).first()[0] == 27
