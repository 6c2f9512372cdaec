"""Evaluation of predictions and retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(pred: DataFrame, by: str | None = None) -> DataFrame:
    """TP, FP, FN, TN, precision, recall, F1, accuracy of (predicted, expected), overall and by group in one pass.

    The overall row has a null group.
    """
    p, e = F.col("predicted"), F.col("expected")
    aggs = [F.count_if(p & e).alias("tp"), F.count_if(p & ~e).alias("fp"), F.count_if(~p & e).alias("fn"), F.count_if(~p & ~e).alias("tn"), F.count("*").alias("total")]
    rows = pred.groupingSets([[], [F.col(by)]], F.col(by)).agg(*aggs) if by else pred.agg(*aggs)
    c = F.col
    precision, recall = _over(c("tp"), c("tp") + c("fp")), _over(c("tp"), c("tp") + c("fn"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    accuracy = _over(c("tp") + c("tn"), c("total"))
    return rows.withColumns({"precision": F.round(precision, 4), "recall": F.round(recall, 4), "f1": F.round(f1, 4), "accuracy": F.round(accuracy, 4)})


def reliability_bins(pred: DataFrame, n_bins: int = 10) -> DataFrame:
    """Per confidence bin: count, accuracy, mean confidence and gap of (confidence, correct); empty bins have zeros."""
    bins = pred.sparkSession.createDataFrame([(i, i / n_bins, (i + 1) / n_bins) for i in range(n_bins)], "bin int, lower double, upper double")
    c = F.col("confidence")
    # every row falls into one bin, found from the bins' own limits
    which = reduce(lambda a, i: F.when((c >= i / n_bins) & ((c <= 1.0) if i == n_bins - 1 else (c < (i + 1) / n_bins)), i).otherwise(a), range(n_bins), F.lit(None).cast("int"))
    rows = pred.groupBy(which.alias("bin")).agg(F.count("*").alias("count"), F.avg(F.col("correct").cast("int")).alias("acc"), F.avg("confidence").alias("conf"))
    out = F.broadcast(bins).join(rows, "bin", "left")
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return out.select(
        "bin", "lower", "upper", F.coalesce("count", F.lit(0)).alias("count"), F.round(z(F.col("acc")), 4).alias("accuracy"), F.round(z(F.col("conf")), 4).alias("avg_confidence"),
        F.round(z(F.abs(F.col("acc") - F.col("conf"))), 4).alias("gap"), z(F.abs(F.col("acc") - F.col("conf"))).alias("raw_gap"),
    )


def ece(pred: DataFrame, n_bins: int = 10) -> DataFrame:
    """Expected calibration error: the bins' gaps weighted by their counts."""
    b = reliability_bins(pred, n_bins)
    return b.agg(F.round(F.coalesce(F.sum(F.col("count") * F.col("raw_gap")) / F.when(F.sum("count") > 0, F.sum("count")), F.lit(0.0)), 4).alias("ece"))


def is_hit(source: Column, value: Column, expected: Column, keywords: Column) -> Column:
    """The source is the expected one and at least one keyword occurs."""
    return (source == expected) & F.exists(keywords, lambda k: value.contains(k))


def hit_ranks(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case (query_id, expected_source, expected_keywords, query_type): rank of the first hit among results (query_id, rank, source, value), or null."""
    r = results.select("query_id", "rank", "source", "value")
    hit = is_hit(F.col("source"), F.col("value"), F.col("expected_source"), F.col("expected_keywords"))
    joined = cases.join(r, "query_id", "left").groupBy("query_id", "query_type").agg(F.min(F.when(hit, F.col("rank"))).alias("first_hit"))
    return joined


def ranking_metrics(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Hit rates at 1, 3 and 5 and mean reciprocal rank, overall (null type) and by query type."""
    ranks = hit_ranks(results, cases)
    at = lambda k: F.round(F.count_if(F.col("first_hit") <= k) / F.count("*"), 4)
    return ranks.groupingSets([[], [F.col("query_type")]], F.col("query_type")).agg(
        F.count("*").alias("total"), at(1).alias("hit_1"), at(3).alias("hit_3"), at(5).alias("hit_5"), F.round(F.avg(F.coalesce(1 / F.col("first_hit"), F.lit(0.0))), 4).alias("mrr")
    )


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def retrieval_failures(cases: DataFrame) -> DataFrame:
    """Adds ``reasons`` to failed cases (passed, source_hit, keyword_hit, detected_type, query_type, is_boundary)."""
    c = F.col
    reasons = _codes(
        (~c("source_hit"), "source_not_found"),
        (c("source_hit"), "source_found_but_ranked_low"),
        (c("source_hit") & ~c("keyword_hit"), "keyword_mismatch"),
        ((c("detected_type") != c("query_type")) & (c("query_type") != "general"), "query_type_misclassified"),
        (c("is_boundary"), "boundary_case"),
    )
    return cases.filter(~c("passed")).withColumn("reasons", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("unknown"))))


def judgement_failures(cases: DataFrame) -> DataFrame:
    """Adds ``reasons`` to wrong judgements (predicted, expected, confidence, predicted_type, expected_type, is_boundary, n_evidence)."""
    c = F.col
    false_alarm = c("predicted") & ~c("expected")
    reasons = _codes(
        (false_alarm, "false_positive"),
        (~false_alarm, "false_negative"),
        (c("is_boundary"), "boundary_case"),
        (false_alarm & (c("predicted_type") != c("expected_type")) & (c("expected_type") != "NONE"), "violation_type_mismatch"),
        (~false_alarm & (c("confidence") < 0.6), "low_confidence"),
        (c("n_evidence") == 0, "evidence_insufficient"),
    )
    return cases.filter(c("predicted") != c("expected")).withColumn("reasons", reasons)


def reason_counts(failures: DataFrame) -> DataFrame:
    return failures.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def compare_versions(metrics: DataFrame, old: str = "v1", new: str = "v2") -> DataFrame:
    """Improvements from one version's metrics (version, precision, recall, f1, accuracy, ece) to another's; less error is better."""
    pick = lambda v, m: F.max(F.when(F.col("version") == v, F.col(m)))
    gain = {m: F.round(pick(new, m) - pick(old, m), 4).alias(f"{m}_delta") for m in ("recall", "precision", "f1", "accuracy")}
    return metrics.agg(*gain.values(), F.round(pick(old, "ece") - pick(new, "ece"), 4).alias("ece_delta"))


def usage_cost(usage: DataFrame, price_in: float = 1.0, price_out: float = 2.0) -> DataFrame:
    """Token sums and their cost, prices per million."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    cost = total("prompt_tokens") / 1e6 * price_in + total("completion_tokens") / 1e6 * price_out
    return usage.agg(*[total(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], F.round(cost, 6).alias("cost"))
