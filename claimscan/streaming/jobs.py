"""The live loops as Structured Streaming jobs. Each equals its batch twin on the same input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscan.functions.work import new_path
from claimscan.operators.judge import SIGNALS, feedback_counts
from claimscan.operators.memory import after_functions, feedback_functions
from claimscan.plans.review import review
from claimscan.sources.buckets import BucketedTable
from claimscan.sources.knowledge import upsert


def stream_review(stream: DataFrame, rules: DataFrame, version: str = "v2", signals: Mapping[str, str] = SIGNALS) -> DataFrame:
    """Stateless: the review of each arriving document."""
    return review(stream, rules, version=version, signals=signals)


def stream_latency(stream: DataFrame, window: str = "1 hour", slide: str | None = None, gap: str | None = None, watermark: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, error rate and percentiles of (ts, latency_ms, is_error) per tumbling or sliding window, or per session with ``gap``.

    ``by`` groups further, and is needed for sessions: Spark keeps none over a whole stream. A row is dropped if it is later than the watermark as it
    was after the batch before the last: what comes in the batch right after a jump in time still counts.
    """
    if gap and not by:
        raise ValueError("sessions need columns to group by")
    w = F.session_window("ts", gap) if gap else F.window("ts", window, slide or window)
    rows = stream.withWatermark("ts", watermark).groupBy(w.alias("w"), *by)
    return rows.agg(
        F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_ms"), F.round(F.count_if("is_error") / F.count("*"), 4).alias("error_rate"), F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], 10_000).alias("percentiles")
    ).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "avg_ms", "error_rate", "percentiles")


def stream_feedback(stream: DataFrame) -> DataFrame:
    """Running counts per word; native state, for update mode."""
    return feedback_counts(stream)


def feedback_sink(memories: DataFrame, state_path: str):
    """A foreachBatch function that folds each batch's feedback (word, action, at) into the confidences kept below ``state_path``.

    A batch that is delivered again writes the same folder again, so the merge is idempotent.
    """
    spark = memories.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.schema("key string, confidence double").parquet(f"{state_path}/{batch_id - 1}") if batch_id else memories.select("key", "confidence")
        after_functions(before, feedback_functions(batch, memories)).write.mode("overwrite").parquet(f"{state_path}/{batch_id}")

    return merge


def confidence_sink(table: BucketedTable, index: DataFrame):
    """A foreachBatch function that folds each batch's feedback (word, action, at) into the memories of ``table``, whose key is ``key``.

    Words are looked for in a written full-text ``index`` of the memories' values (see ``operators.index``), and only buckets that hold a memory with
    a changed confidence are written. A batch that is delivered again changes nothing. See ``state.fold_deltas`` for deltas that come late or out of order.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.change(feedback_functions(batch, table.read(), index=index), after_functions, f"batch {batch_id}")

    return merge


def table_sink(table: BucketedTable, order_col: str):
    """A foreachBatch function that keeps the last row per key in ``table``: a batch writes the buckets of its keys only."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, order_col, f"batch {batch_id}")

    return merge


def dedupe_reviews(stream: DataFrame, watermark: str = "1 hour", key: str = "review_id", ts: str = "ts") -> DataFrame:
    """A resubmitted review counts once: the first one. See ``upsert_sink`` for the last."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def upsert_sink(state_path: str, schema: str, key: str, order_col: str):
    """A foreachBatch function that keeps the last row per key below ``state_path``."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = spark.read.schema(schema).parquet(f"{state_path}/{batch_id - 1}") if batch_id else spark.createDataFrame([], schema)
        upsert(current, batch, key, order_col).write.mode("overwrite").parquet(f"{state_path}/{batch_id}")

    return merge


def run_to_end(stream: DataFrame, name: str, mode: str = "append", batch=None) -> DataFrame | None:
    """Run a query over all input that is there now. Appended rows are written as Parquet and read back."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(batch).start() if batch else writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return None if batch else spark.read.schema(stream.schema).parquet(out)
