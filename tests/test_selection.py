"""Percentiles by selection and labels by binned ranges, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscan.functions.work import stash
from claimscan.operators import analytics
from claimscan.sources import markdown


@pytest.mark.parametrize(("bins", "few"), [(4, 3), (16, 1), (4096, 10_000)])
def test_nth_values(spark, monkeypatch, bins, few):
    monkeypatch.setattr(analytics, "BINS", bins)
    monkeypatch.setattr(analytics, "FEW", few)
    rng = np.random.default_rng(1)
    groups = {"a": rng.integers(0, 50, 300).astype(float), "b": np.full(100, 7.5), "c": rng.normal(size=1), "d": np.exp(rng.normal(size=200) * 5)}
    rows = stash(spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double"), "rows")
    ranks = {(g, f"r{r}"): r for g, vs in groups.items() for r in {1, len(vs) // 2 + 1, len(vs)}}
    wanted = spark.createDataFrame([(g, n, r) for (g, n), r in ranks.items()], "g string, name string, rank long")
    got = {(r.g, r.name): r.v for r in analytics.nth_values(rows, ["g"], wanted, "v").collect()}
    assert got == {k: float(np.sort(groups[k[0]])[r - 1]) for k, r in ranks.items()}


@pytest.mark.parametrize("by", ["kind", None])
def test_metrics_by_selection_equal_sorted_rows(spark, monkeypatch, by):
    for name, n in (("BINS", 8), ("FEW", 5), ("TOP", 0)):
        monkeypatch.setattr(analytics, name, n)
    rng = np.random.default_rng(2)
    # one group has nearly all rows; many equal times, on the cut too, and equal latencies
    rows = [("hot" if i % 20 else ["x", "y"][i % 40 // 20], int(rng.integers(0, 40)), float(rng.integers(0, 9)), bool(i % 7 == 0)) for i in range(900)]
    rows += [("one", 5, 3.0, True)]
    events = spark.createDataFrame(rows, "kind string, t long, latency_ms double, is_error boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.kind if by else "all": r for r in analytics.latency_metrics(events, 60, by).collect()}
    for g in {r[0] for r in rows} if by else {"all"}:
        own = [r for r in rows if g in ("all", r[0])]
        newest = sorted(v for _, v in sorted(((r[1], r[2]) for r in own), reverse=True)[:60])
        n, r = len(newest), got[g]
        assert (r.p50_ms, r.p95_ms, r.p99_ms) == tuple(newest[min(n * p // 100, n - 1)] for p in (50, 95, 99))
        assert (r.total, r.min_ms, r.max_ms, r.avg_ms) == (len(own), newest[0], newest[-1], pytest.approx(np.mean(newest), abs=0.006))


def test_binned_ranges_equal_the_nested_loop(spark):
    rng = np.random.default_rng(3)
    ranges = [(int(lo), int(lo + w), f"r{i}") for i, (lo, w) in enumerate(zip(rng.integers(-50, 900, 60), rng.integers(0, 120, 60), strict=True))] + [(5, 1, "empty"), (None, 3, "null"), (-1000, 5000, "all")]
    r = spark.createDataFrame(ranges, "lo long, hi long, label string")
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(-100, 1100, 200))] + [(900, None), (901, -100_000), (902, 7), (903, 7)], "id long, n long")
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert rows(markdown.range_label(df, "n", r, limit=0)) == rows(markdown.range_label(df, "n", r))
    text = df.select("id", F.concat(F.lit("no. "), "n").alias("n"))
    assert rows(markdown.range_label(text, "n", r, limit=0)) == rows(markdown.range_label(text, "n", r))


def test_many_ranges_and_numbers(spark):
    n = 150_000
    ranges = spark.range(n).select((F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 7).alias("hi"), F.col("id").cast("string").alias("label"))
    df = spark.range(n).select((F.col("id") * 9).alias("v"))
    out = markdown.range_label(df, "v", ranges)
    wrong = out.filter(F.col("label") != F.when(F.col("v") % 10 <= 7, F.floor(F.col("v") / 10).cast("string")).otherwise(""))
    assert out.count() == n and wrong.count() == 0
