"""A full-text index that lives on: rows come, change and go without a rebuild.

The index is a folder. Segments of trigram postings (see ``search.segments_of``) are only ever added; a row that is changed or deleted is named in a
table of dead rows, which a reader joins to the segments; and segments with many dead rows, or few rows, are now and then merged
into new ones from the texts they hold. What belongs to a version of the index stands in its manifest, a small table to which a version is added last, so a
reader sees a whole version or none, and a job that is lost half-way leaves the version before as it was.

A change reads the keys of the index and writes segments of the changed rows only. Readers get a DataFrame of segments, which ``search.fulltext_topk``,
``search.retrieve`` and ``plans.review.cite`` take as ``index``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscan.functions.work import in_arrow, new_path, small_side, stash, write_large
from claimscan.operators.search import INDEX, SEGMENT, _columns, _segments, index_fields, segments_of

FIELDS = ("key", "value", "source", "tags")
#: Dead rows that are broadcast to the segments; beyond that they are joined by a shuffle.
BROADCAST_DEAD = 2_000_000
MANIFEST = "version long, kind string, folder string, gen int, key_type string, names string"


class Index:
    """The index in a folder; ``create`` or ``open`` makes one."""

    def __init__(self, spark: SparkSession, path: str, state: list):
        self.spark, self.path, self.state = spark, path, state

    @classmethod
    def create(cls, corpus: DataFrame, path: str | None = None, names: tuple[str, ...] = FIELDS) -> Index:
        """An index of ``corpus`` (key, and the fields ``names``; distinct keys) in a new folder."""
        spark = corpus.sparkSession
        index = cls(spark, new_path(spark, "fulltext") if path is None else path, [])
        index._commit([("segments", index._write(index_fields(corpus, names)), 0, dict(corpus.dtypes)["key"], ",".join(names))])
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The newest version in the folder."""
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        newest = rows.agg(F.max("version")).first()[0]
        return cls(spark, path, rows.filter(F.col("version") == newest).collect())

    @property
    def version(self) -> int:
        return self.state[0].version if self.state else 0

    def _commit(self, parts: list[tuple]) -> None:
        rows = self.spark.createDataFrame([(self.version + 1, *p) for p in parts], MANIFEST)
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.state = rows.collect()

    def _parts(self) -> list[tuple]:
        return [tuple(r)[1:] for r in self.state]

    def _folders(self, kind: str) -> list[str]:
        return [r.folder for r in self.state if r.kind == kind]

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.path}/segments-{uuid.uuid4().hex}"
        write_large(segments_of(rows).withColumn("segment", F.monotonically_increasing_id()), folder)
        return folder

    def _all(self) -> DataFrame:
        """All segments, with ``gen`` and ``segment``."""
        kind, out = self.state[0].key_type, None
        for r in self.state:
            if r.kind == "segments":
                df = self.spark.read.schema(f"{INDEX.format(key=kind)}, segment long").parquet(r.folder).withColumn("gen", F.lit(r.gen))
                out = df if out is None else out.unionByName(df)
        return out

    def _dead(self) -> DataFrame:
        """(gen, segment, row) of dead rows; a row of -1 is the whole segment."""
        folders = self._folders("dead")
        schema = "gen int, segment long, row int"
        return self.spark.read.schema(schema).parquet(*folders).distinct() if folders else self.spark.createDataFrame([], schema)

    def segments(self) -> DataFrame:
        """The segments, with the dead rows of each in ``dead``."""
        if not self._folders("dead"):
            return self._all().withColumn("dead", F.array().cast("array<int>"))
        each = self._dead().groupBy("gen", "segment").agg(F.sort_array(F.collect_list("row")).alias("dead"))
        rows = self._all().join(small_side(each, BROADCAST_DEAD), ["gen", "segment"], "left")
        return rows.withColumn("dead", F.coalesce("dead", F.array().cast("array<int>"))).filter(~F.array_contains("dead", -1))

    def _where(self, keys: DataFrame) -> DataFrame:
        """(gen, segment, row) of the rows with these keys; reads the keys of the index only."""
        each = self._all().select("gen", "segment", F.posexplode("keys").alias("row", "key"))
        return each.join(small_side(stash(keys.select("key").distinct(), "keys")), "key", "left_semi").select("gen", "segment", "row")

    def upsert(self, rows: DataFrame) -> None:
        """Adds ``rows`` (key and the index's fields; distinct keys), or puts them in the place of those with their keys."""
        rows = stash(index_fields(rows, tuple(self.state[0].names.split(","))), "changed")
        self._change(rows, rows)

    def delete(self, keys: DataFrame) -> None:
        self._change(keys, None)

    def _change(self, keys: DataFrame, rows: DataFrame | None) -> None:
        parts, gen = self._parts(), max(r.gen for r in self.state) + 1
        dead = f"{self.path}/dead-{uuid.uuid4().hex}"
        self._where(keys).write.parquet(dead)
        parts.append(("dead", dead, gen, self.state[0].key_type, self.state[0].names))
        if rows is not None:
            parts.append(("segments", self._write(rows), gen, self.state[0].key_type, self.state[0].names))
        self._commit(parts)

    def merge(self, most_dead: float = 0.3, least: int = SEGMENT // 4) -> int:
        """Writes anew the rows of segments of which more than ``most_dead`` of the rows are dead or that have less than ``least`` trigrams; their number."""
        size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
        worn = (F.size("dead") > F.size("keys") * F.lit(most_dead)) | (size < least)
        chosen = stash(self.segments().filter(worn).select("gen", "segment"), "chosen")
        n = chosen.count()
        if n < 2 and not self._folders("dead"):
            return 0
        parts, gen = self._parts(), max(r.gen for r in self.state) + 1
        live = self.segments().join(small_side(chosen), ["gen", "segment"])
        folder = self._write(_rows_of(live, self.state[0].key_type))
        gone, dead = chosen.select("gen", "segment", F.lit(-1).alias("row")), f"{self.path}/dead-{uuid.uuid4().hex}"
        still = self._dead().join(chosen, ["gen", "segment"], "left_anti").unionByName(gone)
        # generations of which no segment is left are no longer read
        every = self._all().select("gen", "segment")
        kept = {r.gen for r in every.join(still.filter("row = -1"), ["gen", "segment"], "left_anti").select("gen").distinct().collect()}
        still.filter(F.col("gen").isin(list(kept))).write.parquet(dead)
        kind, names = self.state[0].key_type, self.state[0].names
        self._commit([*(p for p in parts if p[0] == "segments" and p[2] in kept), ("dead", dead, gen, kind, names), ("segments", folder, gen, kind, names)])
        return n


def _rows_of(segments: DataFrame, kind: str) -> DataFrame:
    """(key, size, text) of the live rows of segments."""
    import pyarrow as pa

    def run(batches):
        for batch, i, seg in _segments(batches):
            at = pa.array(seg.live.nonzero()[0])
            yield pa.RecordBatch.from_arrays([seg.keys.take(at), pa.array(seg.sizes).take(at), seg.texts.take(at)], ["key", "size", "text"])

    return in_arrow(_columns(segments, "keys", "sizes", "texts"), run, f"key {kind}, size long, text string")
