"""State per key, kept by Spark: a micro-batch touches the keys it brings and those whose timers fire.

Needs the RocksDB state store, which ``use_rocksdb`` sets for a session.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Result of ``fold_deltas``.
LOG = "key string, step int, old_confidence double, new_confidence double, delta double, reason string, at timestamp"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Fold(StatefulProcessor):
    """Holds a key's deltas until the watermark has passed them, and then adds them up in order, clamped after each."""

    def __init__(self, lo: float, hi: float, start: float):
        self.lo, self.hi, self.start = lo, hi, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "step int, confidence double")
        self.waiting = handle.getListState("waiting", "at timestamp, delta double, reason string, start double")

    def handleInputRows(self, key, rows, timerValues):
        new = [(r.at, r.delta, r.reason, r.start) for df in rows for r in df.itertuples(index=False)]
        self.waiting.appendList(new)
        # one timer a time of the key's; a timer set twice is one
        for at in {int(pd.Timestamp(r[0]).timestamp() * 1000) + 1 for r in new}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((x for x in held if pd.Timestamp(x[0]).timestamp() * 1000 < due), key=lambda x: (x[0], x[1], x[2]))
        if not ready:  # another timer of the key fired for all of them
            return
        left = [x for x in held if pd.Timestamp(x[0]).timestamp() * 1000 >= due]
        if self.value.exists():
            step, now = self.value.get()
        else:
            known = [x[3] for x in held if x[3] is not None and x[3] == x[3]]
            step, now = 0, known[0] if known else self.start
        out = []
        for at, delta, reason, _ in ready:
            old, now, step = now, min(self.hi, max(self.lo, now + delta)), step + 1
            out.append((key[0], step, old, now, delta, reason, at))
        self.value.update((step, now))
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])

    def close(self) -> None:
        pass


def fold_deltas(stream: DataFrame, watermark: str = "1 hour", lo: float = 0.0, hi: float = 1.0, start: float = 0.5) -> DataFrame:
    """The log of ``memory.apply_confidence`` of a stream of deltas (key, at, delta, reason and, optionally, start), for append mode.

    Deltas may come in any order within ``watermark``; a key's are added up in the order of time once the watermark has passed them. ``start`` (of the first delta
    that has one) or the default is what a key starts from.
    """
    rows = stream if "start" in stream.columns else stream.withColumn("start", F.lit(None).cast("double"))
    rows = rows.select(F.col("key").cast("string").alias("key"), "at", F.col("delta").cast("double").alias("delta"), F.coalesce("reason", F.lit("")).alias("reason"), F.col("start").cast("double").alias("start"))
    rows = rows.filter("key IS NOT NULL AND delta IS NOT NULL").withWatermark("at", watermark)
    return rows.groupBy("key").transformWithStateInPandas(_Fold(lo, hi, start), LOG, "append", "eventTime")


class _Last(StatefulProcessor):
    """Keeps the last row of a key."""

    def __init__(self, schema: str, names: list[str], order_col: str, days: int | None):
        self.schema, self.names, self.order_col, self.days = schema, names, order_col, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema, None if self.days is None else self.days * 86_400_000)

    def handleInputRows(self, key, rows, timerValues):
        at = self.names.index(self.order_col)
        # of equally late rows that with the greatest other values, as in a batch
        rank = lambda r: (r[at], *(x for i, x in enumerate(r) if i != at))
        new = max((tuple(r) for df in rows for r in df[self.names].itertuples(index=False)), key=rank)
        before = self.last.get() if self.last.exists() else None
        if before is None or rank(new) > rank(tuple(before)):
            self.last.update(new)
            yield pd.DataFrame([(key[0], *new)], columns=["key", *self.names])

    def close(self) -> None:
        pass


def keep_last(stream: DataFrame, key: str, order_col: str, forget_days: int | None = None) -> DataFrame:
    """A row each time a key's last row changes, for update mode; after ``forget_days`` without a row a key is forgotten, if given (such a stream
    goes on until it is stopped).

    Written to a ``BucketedTable`` (see ``jobs.table_sink``) this keeps a table of the last rows, of which a micro-batch touches its keys' buckets only.
    """
    names = [c for c in stream.columns if c != key]
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    rows = stream.select(F.col(key).alias("key"), *names)
    out = rows.groupBy("key").transformWithStateInPandas(_Last(schema, names, order_col, forget_days), f"key {kinds[key]}, {schema}", "update", "None" if forget_days is None else "processingTime")
    return out.withColumnRenamed("key", key)
