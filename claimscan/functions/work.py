"""Intermediate tables: written as Parquet below ``spark.checkpoint.dir``, which every executor shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Small sides (rules, lexica, weights) are collected or broadcast up to so many rows.
MAX_SMALL = 100_000
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


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/claimscan-{uuid.uuid4().hex}/{name}"


def write_large(df: DataFrame, path: str) -> None:
    """Writes rows of some megabytes, a row group each: Parquet would keep the first hundred of a file in memory, and read all of a group at once."""
    df.write.option("parquet.block.row.count.limit", 1).parquet(path)


def stash(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back: cuts the lineage and survives lost executors. ``large``: see ``write_large``."""
    path = new_path(df.sparkSession, name)
    (write_large if large else lambda rows, to: rows.write.parquet(to))(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, over as many partitions as there are cores if its files make fewer: a small file would else be one task."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def small_rows(df: DataFrame, limit: int = MAX_SMALL) -> list:
    """The rows of a table that must be small (rules, weights, patterns); an error if it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a table of rules or weights has more than {limit} rows")
    return rows


def small_side(df: DataFrame, limit: int = MAX_SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else unchanged (a shuffle join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def in_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of bounded size, for rows that may be large."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` consecutive rows of a partition as one row: every column becomes an array. Nothing is shuffled."""

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), rows):
                batch = whole.slice(at, rows)
                offsets = pa.array([0, len(batch)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, c) for c in batch.columns], batch.schema.names)

    return in_arrow(df, run, ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in df.schema))


def paired(packs: DataFrame, blocks: DataFrame, limit: int) -> DataFrame:
    """Every pack beside every block (written rows with ``block`` 0, 1, ...): an equi-join on the block's number, broadcast up to ``limit`` blocks."""
    n = blocks.count()
    numbered = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else packs.limit(0).withColumn("block", F.lit(0))
    return numbered.join(F.broadcast(blocks) if n <= limit else blocks, "block")


def in_blocks(rows: DataFrame, size: int, by: str) -> DataFrame:
    """Written rows (block, rows): ``rows`` (distinct in ``by``) in blocks of about ``size``, each an array of structs."""
    rows = stash(rows, "block_rows")
    n = max(1, -(-rows.count() // size))
    numbered = rows.withColumn("block", F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
    grouped = stash(numbered.groupBy("block").agg(F.collect_list(F.struct(*rows.columns)).alias("rows")), "blocks")
    if n == 1:
        return grouped
    # a number that no row has is left out
    order = W.partitionBy(F.lit(0)).orderBy("block")  # one row a block
    return stash(grouped.select((F.row_number().over(order) - 1).alias("block"), "rows"), "blocks") if grouped.count() < n else grouped
