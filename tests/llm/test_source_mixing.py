"""Source mixing against a plain version, with the cases its docstring names."""

import hashlib
import re

from claimscan.llm import source_mixing as m

from .brute import edge_docs, empty_docs


def plain_targets(sizes, weights, epochs=3):
    """Clamp and share out again, one source at a time."""
    whole, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        total = sum(weights[s] for s in free)
        level = (whole - sum(fixed.values())) / total if total else 0
        above = [s for s in free if weights[s] * level > epochs * sizes[s]]
        if not above:
            return fixed | {s: weights[s] * level for s in free}
        fixed |= {s: float(epochs * sizes[s]) for s in above}


def plain_mix(rows, weights, epochs=3, refills=2, seed=12):
    """{(doc_id, text, source): (size, target, repeats)} of rows (doc_id, text, source)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    h = lambda d, t: int(hashlib.md5(f"{seed}|{'-' if d is None else d}|{'-' if t is None else t}".encode()).hexdigest()[:15], 16)
    own = {}
    for d, t, s in rows:
        own.setdefault(s, []).append((h(d, t), size(t), d, t))
    sizes = {s: sum(x[1] for x in r) for s, r in own.items()}
    targets = plain_targets(sizes, weights, epochs)
    out = {}
    for s, r in own.items():
        whole = int(targets[s] // sizes[s]) if sizes[s] else 0
        quota = int(targets[s] - whole * sizes[s] + 0.5)
        left, after, hit = quota, -1, set()
        for _ in range(refills + 1):
            sums, limit = {}, left
            for x in r:
                if 0 < x[1] <= limit and x[0] > after:
                    sums[x[0]] = sums.get(x[0], 0) + x[1]
            for key in sorted(sums):
                after = key
                if sums[key] > left:
                    break
                left -= sums[key]
                hit.add(key)
            else:
                after = 1 << 60 if sums else after
        for x in r:
            out[x[2], x[3], s] = (x[1], targets[s], whole + (x[0] in hit and x[1] > 0))
    return out


def compare(spark, rows, weights, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = spark.createDataFrame([(s, float(x)) for s, x in weights.items()], "source string, weight double")
    got = m.mix(docs, w, **kw).collect()
    want = plain_mix(rows, weights, **kw)
    assert len(got) == len(rows)
    for r in got:
        size, target, repeats = want[r.doc_id, r.text, r.source]
        assert (r["size"], r.taken) == (size, r.repeats * size)
        assert abs(r.target - target) < 1e-6 * max(1, target)
        assert size == 0 or r.repeats == repeats
        assert r.taken <= kw.get("epochs", 3) * size
    return got


def test_mix_equals_plain_version(spark):
    rows = [(i, " ".join(["w"] * (i * 7919 % 90)), ["big", "small", None, "c"][min(3, i % 11)]) for i in range(600)]
    rows += [(9000 + i, "one two", "tiny") for i in range(3)]
    weights = {"big": 1, "small": 2, None: 3, "c": 1, "tiny": 5}
    got = compare(spark, rows, weights)
    for s in weights:
        of = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= max(r["size"] for r in of)
    assert {r.repeats for r in got if r.source == "tiny"} == {3}  # clamped at the cap


def test_mix_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n ", "a"), (4, "x " * 50000, "b"), (5, "x", "b"), (None, "no id", "b"), (6, "t", None), (7, "t", None), (8, "a b c d", "c")]
    compare(spark, rows, {"a": 3, "b": 1, None: 1, "c": 2})
    compare(spark, rows, {"a": 1, "b": 1, None: 1, "c": 1}, epochs=1)


def test_repeated_rows_go_together(spark):
    rows = [(1, "a b c", "s")] * 4 + [(2, "d e", "s"), (3, "f", "s"), (4, "g " * 30, "t")]
    compare(spark, rows, {"s": 5, "t": 1})


def test_water_fill_cascades(spark):
    sizes = {"a": 1, "b": 10, "c": 100, "d": 10000}
    for weights in ({"a": 1000, "b": 100, "c": 10, "d": 1}, {"a": 1, "b": 1, "c": 1, "d": 1}):
        df = spark.createDataFrame([(s, n, float(weights[s])) for s, n in sizes.items()], "source string, size long, weight double")
        got = {r.source: r.target for r in m.water_fill(df).collect()}
        want = plain_targets(sizes, weights)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)
        assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def test_other_columns_and_empty_table(spark):
    docs = edge_docs(spark).withColumnRenamed("n_words", "taken")
    w = spark.createDataFrame([("s", 1.0), (None, 2.0)], "source string, weight double")
    out = m.mix(docs, w)
    assert out.count() == docs.count()
    assert {"lang", "kept", "score", "shard", "source_size"} <= set(out.columns)
    assert m.repeated(out).filter("copy > repeats").count() == 0
    assert m.repeated(out).count() == sum(r.repeats for r in out.collect())
    assert m.mix(empty_docs(spark), w).count() == 0


def test_sources_without_weight_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c d", "y")], "doc_id long, text string, source string")
    out = m.mix(docs, spark.createDataFrame([("x", 1.0)], "source string, weight double")).collect()
    assert [(r.doc_id, r.target, r.repeats) for r in out] == [(1, 2.0, 1)]


def test_numbered(spark):
    df = spark.createDataFrame([(s,) for s in ["b", "é", "a", None, "Z", "\U0001f600"]], "source string")
    from pyspark.sql import functions as F

    got = {r.source: r.number for r in m.numbered(df, F.col("source").asc_nulls_last()).collect()}
    assert got == {"Z": 0, "a": 1, "b": 2, "é": 3, "\U0001f600": 4, None: 5}


def test_same_rows_each_time_and_on_other_partitions(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 37), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    w = spark.createDataFrame([("s0", 1.0), ("s1", 2.0), ("s2", 3.0)], "source string, weight double")
    runs = [sorted((r.doc_id, r.repeats) for r in m.mix(docs.repartition(n), w).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    other = sorted((r.doc_id, r.repeats) for r in m.mix(docs, w, seed=13).collect())
    assert other != runs[0]
