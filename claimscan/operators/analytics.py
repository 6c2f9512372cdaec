"""Review, feedback and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimscan.functions.work import small_side, stash

LEVELS = ["high", "medium", "low", "pass"]
VIOLATIONS = "array<struct<text: string, category: string, severity: string>>"
#: Parts of a bracket that are counted at a time; rows of a bracket that are put in order; newest rows that are found by a top-n.
BINS, FEW, TOP = 4096, 10_000, 100_000
UNKNOWN = "未知"  # fixed value: label of a missing category


def review_totals(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count("*").alias("total_reviews"), F.coalesce(F.sum("violation_count"), F.lit(0)).cast("long").alias("total_violations"))


def violations_by(reviews: DataFrame, by: str) -> DataFrame:
    """Stored violations by category or severity; the four severities are zero-filled and others ignored."""
    v = F.from_json("violations", VIOLATIONS) if dict(reviews.dtypes)["violations"] == "string" else F.col("violations")
    rows = reviews.filter("violation_count > 0").select(F.explode(v).alias("v"))
    if by == "category":
        return rows.groupBy(F.coalesce("v.category", F.lit(UNKNOWN)).alias("category")).agg(F.count("*").alias("n"))
    counts = rows.groupBy(F.coalesce("v.severity", F.lit("low")).alias("severity")).agg(F.count("*").alias("n"))
    levels = reviews.sparkSession.createDataFrame([(x,) for x in LEVELS], "severity string")
    return counts.join(F.broadcast(levels), "severity", "right").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def recent_reviews(reviews: DataFrame, n: int = 10) -> DataFrame:
    return reviews.orderBy(F.desc("created_at"), "review_id").limit(n).select("review_id", F.substring("text", 1, 30).alias("preview"), "status", "overall_risk", "violation_count")


def feedback_by_violation(feedback: DataFrame, n: int | None = 20) -> DataFrame:
    """Counts per violation, of the busiest n or, if None, of all."""
    one = lambda a: F.count_if(F.col("action") == a)
    rows = feedback.groupBy("violation_id").agg(one("confirm").alias("confirms"), one("dismiss").alias("dismisses"), one("modify").alias("modifies"), F.count("*").alias("total"))
    return rows if n is None else rows.orderBy(F.desc("total"), "violation_id").limit(n)


def feedback_totals(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count("*").alias("total"), *[F.count_if(F.col("action") == a).alias(a) for a in ("confirm", "modify", "dismiss")])


def learning_adjustments(counts: DataFrame, minimum: int = 3) -> DataFrame:
    """Words whose feedback is one-sided enough: direction and magnitude."""
    no, yes = F.col("dismisses") / F.col("total"), F.col("confirms") / F.col("total")
    kind = F.when(no >= 0.7, F.struct(F.lit("down").alias("direction"), F.lit(0.15).alias("magnitude"))).when(yes >= 0.8, F.struct(F.lit("up").alias("direction"), F.lit(0.1).alias("magnitude")))
    rows = counts.filter(F.col("total") >= minimum).withColumn("k", kind).filter("k IS NOT NULL")
    return rows.select("violation_id", "k.direction", "k.magnitude", F.col("total").alias("sample_count"))


def _rank(n: Column, p: int) -> Column:
    """The place, from 1, of percentile p in n sorted values."""
    return F.least(F.floor(n * p / 100), n - 1) + 1


def nth_values(rows: DataFrame, by: list[str], wanted: DataFrame, value: str) -> DataFrame:
    """(by..., name, value): of the written ``rows`` (by..., value) of each group the value at each of its ranks ``wanted`` (by..., name, rank from 1; few rows a group).

    No group is sorted. A rank is bracketed by its group's least and greatest value; each pass counts the rows in BINS parts of the bracket and goes on with the part
    that has the rank, until it holds one value or few rows, which are put in order.
    """
    ends = rows.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))
    state = stash(wanted.join(ends, by).withColumn("before", F.lit(0).cast("long")), "brackets")
    key, alike = [*by, "name"], ["rank", "lo", "hi", "before"]
    while True:
        open_ = stash(state.filter((F.col("hi") > F.col("lo")) & (F.col("n") > FEW)), "open")
        if not open_.limit(1).count():
            break
        inside = rows.join(small_side(open_.drop("n")), by).filter(F.col(value).between(F.col("lo"), F.col("hi")))
        part = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        counts = inside.groupBy(*key, part.alias("part")).agg(*[F.first(c).alias(c) for c in ("rank", "before")], F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        upto = F.col("before") + F.sum("n").over(W.partitionBy(*key).orderBy("part"))  # at most BINS rows
        there = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        closed = state.join(open_.select(*key), key, "left_anti")
        state = stash(closed.unionByName(there.withColumn("before", F.col("upto") - F.col("n")).select(*closed.columns)), "brackets")
    one = state.filter(F.col("hi") == F.col("lo")).select(*key, F.col("lo").alias(value))
    few = rows.join(small_side(state.filter(F.col("hi") > F.col("lo")).select(*key, *alike)), by).filter(F.col(value).between(F.col("lo"), F.col("hi")))
    place = F.col("before") + F.row_number().over(W.partitionBy(*key).orderBy(value))
    return one.unionByName(few.withColumn("place", place).filter(F.col("place") == F.col("rank")).select(*key, value))


def _newest(events: DataFrame, by: list[str], last_n: int) -> DataFrame:
    """(by..., latency_ms) of the newest ``last_n`` rows of each group, of equal times the slowest, without sorting a group."""
    rows = stash(events.select(*by, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("latency_ms").cast("double").alias("latency_ms")), "latencies")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("size"))
    cut = nth_values(rows, by, sizes.filter(F.col("size") > last_n).select(*by, F.lit("at").alias("name"), (F.col("size") - last_n + 1).alias("rank")), "at").select(*by, F.col("at").alias("cut"))
    rows = stash(rows.join(small_side(stash(cut, "cuts")), by, "left"), "cut")
    later = rows.filter(F.col("cut").isNull() | (F.col("at") > F.col("cut"))).select(*by, "latency_ms")
    # of the rows at the cut so many, the slowest; equal ones are told by their number
    at_cut = stash(rows.filter(F.col("at") == F.col("cut")).select(*by, "latency_ms"), "at_cut")
    more = rows.filter("cut IS NOT NULL").groupBy(*by).agg((F.lit(last_n) - F.count_if(F.col("at") > F.col("cut"))).alias("more"), F.count_if(F.col("at") == F.col("cut")).alias("equal"))
    more = stash(more, "more")
    least = nth_values(at_cut, by, more.select(*by, F.lit("least").alias("name"), (F.col("equal") - F.col("more") + 1).alias("rank")), "latency_ms").select(*by, F.col("latency_ms").alias("least"))
    least = stash(least, "least")
    slow = at_cut.join(small_side(least), by).filter(F.col("latency_ms") > F.col("least")).select(*by, "latency_ms")
    taken = slow.groupBy(*by).agg(F.count("*").alias("taken"))
    rest = more.join(least, by).join(taken, by, "left").withColumn("left", F.col("more") - F.coalesce("taken", F.lit(0)))
    copies = rest.filter(F.col("left") > 0).select(*by, F.col("least").alias("latency_ms"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))).alias("i")).drop("i")
    return stash(later.unionByName(slow).unionByName(copies), "newest")


def latency_metrics(events: DataFrame, last_n: int = 1000, by: str | None = None, approximate: bool = False) -> DataFrame:
    """Exact rank percentiles, mean, least and most of the newest ``last_n`` latencies; count, rate and error rate of all.

    events: ts, latency_ms, is_error, none of them null. Up to TOP newest rows without ``by`` are found by a bounded top-n; else they and the percentiles are
    found by ``nth_values``, so that no group is sorted in one task, whatever its size.
    ``approximate`` takes the percentiles from a sketch instead of sorting the newest rows, for a large ``last_n``.
    """
    keys = [by] if by else []
    part = W.partitionBy(F.lit(1))
    if by or last_n > TOP:
        newest = _newest(events if by else events.withColumn("__all", F.lit(1)), keys or ["__all"], last_n)
    else:
        newest = events.orderBy(F.desc("ts"), F.desc("latency_ms")).limit(last_n)
    if approximate:
        ranked, at = newest, lambda p: F.round(F.percentile_approx("latency_ms", p / 100, 10_000), 2)
    elif by or last_n > TOP:
        own = keys or ["__all"]
        ranks = newest.groupBy(*own).agg(F.count("*").alias("n")).select(*own, F.explode(F.array(*[F.struct(F.lit(f"p{p}").alias("name"), _rank(F.col("n"), p).alias("rank")) for p in (50, 95, 99)])).alias("x")).select(*own, "x.*")
        picked = stash(nth_values(newest, own, ranks, "latency_ms").groupBy(*own).agg(*[F.max(F.when(F.col("name") == f"p{p}", F.col("latency_ms"))).alias(f"at{p}") for p in (50, 95, 99)]), "picked")
        ranked, at = newest.join(small_side(picked), own), lambda p: F.round(F.first(f"at{p}"), 2)
    else:
        ranked = newest.select(*keys, "latency_ms", F.row_number().over(part.orderBy("latency_ms")).alias("r"), F.count("*").over(part).alias("n"))
        at = lambda p: F.round(F.max(F.when(F.col("r") == _rank(F.col("n"), p), F.col("latency_ms"))), 2)
    recent = ranked.groupBy(*keys).agg(
        *[at(p).alias(f"p{p}_ms") for p in (50, 95, 99)], F.round(F.avg("latency_ms"), 2).alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms")
    )
    seconds = F.greatest((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6, F.lit(1.0))
    total = events.groupBy(*keys).agg(F.count("*").alias("total"), F.round(F.count("*") / seconds, 6).alias("per_second"), F.round(F.count_if("is_error") / F.greatest(F.count("*"), F.lit(1)), 4).alias("error_rate"))
    out = recent.join(total, by) if by else recent.withColumn("__one", F.lit(1)).join(total.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return out.withColumns({"rate_ok": F.col("per_second") >= 5, "p99_ok": F.col("p99_ms") <= 2000})
