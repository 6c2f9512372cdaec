"""A table in hash buckets of its key, of which an upsert writes only the buckets that hold a changed key.

A bucket is a folder of files that never changes. The table's manifest says, for each version, in which folder each bucket lies; a version is added last,
so a reader sees a whole version or none, an upsert that is lost half-way leaves the table as it was, and one that is repeated gives the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscan.functions.work import new_path, stash
from claimscan.sources.knowledge import upsert

MANIFEST = "version long, tag string, bucket int, folder string"


class BucketedTable:
    """The table in a folder; ``create`` or ``open`` makes one."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, n: int, version: int, tag: str | None, folders: dict[int, str]):
        self.spark, self.path, self.schema, self.key, self.n, self.version, self.tag, self.folders = spark, path, schema, key, n, version, tag, folders

    @classmethod
    def create(cls, rows: DataFrame, key: str = "key", n: int = 64, path: str | None = None) -> BucketedTable:
        """A table of ``rows`` (distinct in ``key``) in ``n`` buckets; choose so many that one of them is a few files of usual size."""
        spark = rows.sparkSession
        table = cls(spark, new_path(spark, "buckets") if path is None else path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), key, n, 0, None, {})
        spark.createDataFrame([(table.schema, key, n)], "schema string, key string, n int").coalesce(1).write.parquet(f"{table.path}/layout")
        table._commit(table._write(rows), None)
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BucketedTable:
        layout = spark.read.schema("schema string, key string, n int").parquet(f"{path}/layout").first()
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        newest = rows.agg(F.max("version")).first()[0]
        found = rows.filter(F.col("version") == newest).collect()  # a row a bucket
        return cls(spark, path, layout.schema, layout.key, layout.n, newest, found[0].tag, {r.bucket: r.folder for r in found if r.bucket >= 0})

    def bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.n)).cast("int"))

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Writes the buckets of ``rows``; {bucket: folder}."""
        folder = f"{self.path}/rows-{uuid.uuid4().hex}"
        dealt = stash(self.bucket(rows).repartition(F.col("bucket")), "dealt")
        dealt.write.partitionBy("bucket").parquet(folder)
        return {r.bucket: f"{folder}/bucket={r.bucket}" for r in dealt.select("bucket").distinct().collect()}

    def _commit(self, changed: dict[int, str], tag: str | None) -> None:
        self.folders, self.version, self.tag = self.folders | changed, self.version + 1, tag
        rows = [(self.version, tag, b, f) for b, f in self.folders.items()] or [(self.version, tag, -1, "")]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets."""
        folders = [f for b, f in sorted(self.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def change(self, incoming: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], tag: str | None = None) -> list[int]:
        """Replaces the buckets of the keys of ``incoming`` by ``merged(their rows, incoming)``; the buckets that were written.

        ``tag`` names the change: one that the newest version already has is not made again.
        """
        if tag is not None and tag == self.tag:
            return []
        incoming = stash(self.bucket(incoming.filter(F.col(self.key).isNotNull())), "incoming")
        touched = sorted(r.bucket for r in incoming.select("bucket").distinct().collect())  # at most ``n``
        self._commit(self._write(merged(self.read(touched), incoming.drop("bucket"))) if touched else {}, tag)
        return touched

    def upsert(self, incoming: DataFrame, order_col: str = "updated_at", tag: str | None = None) -> list[int]:
        """``knowledge.upsert`` of the touched buckets."""
        return self.change(incoming, lambda rows, new: upsert(rows, new, self.key, order_col), tag)
