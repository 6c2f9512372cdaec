"""Intermediate tables: written as Parquet below ``spark.checkpoint.dir``, which every executor shares.

A written table cuts the lineage, survives a lost executor and can be read with column pruning.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of rows that Spark sends to a Python worker at a time, unless the session sets its own number.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is set and all runs in one process (tests) a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="claimscan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back.

    ``large`` is for rows of some megabytes: each is a row group, as Parquet would keep the first hundred of a file in memory, and read all of a group at once.
    """
    path = f"{shared_dir(df.sparkSession)}/claimscan-{uuid.uuid4().hex}/{name}"
    writer = df.write.option("parquet.block.row.count.limit", 1) if large else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of bounded size; the worker gives freed memory back when a task ends."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def lean(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed pages otherwise
            trim(0)

    return df.mapInArrow(lean, schema)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else unchanged (a shuffle join).

    ``df`` should be a stashed table, so that the count reads only Parquet footers.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def most_frequent(df: DataFrame, n: str, limit: int) -> DataFrame:
    """The rows of ``df`` with the greatest ``n``, at most ``limit``, without a sort: those above the lowest level of a
    geometric scale (16 levels to a factor e) above which no more rows are. ``df`` should be stashed.
    """
    level = F.floor(F.log(F.col(n).cast("double")) * 16)
    rows, lowest = 0, None
    for r in sorted(df.groupBy(level.alias("level")).count().collect(), reverse=True):  # a few hundred levels
        if r[0] is None or rows + r[1] > limit:
            break
        rows, lowest = rows + r[1], r[0]
    return df.filter(level >= lowest) if lowest is not None else df.limit(0)


def row_key(doc_id: Column, text: Column) -> Column:
    """doc_id; for a row without one, a number from its text that is above any usual doc_id."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62))


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, over as many partitions as there are cores if its files make fewer: a small file would else be one task."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
