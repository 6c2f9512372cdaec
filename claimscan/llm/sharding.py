"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

Jump hashing needs no ring table: a 64-bit generator seeded with the key is stepped until the next
jump would pass the number of shards. When shards are appended, a key either stays or jumps into a
new shard, so only the necessary fraction moves.

Cases: a null key is hashed as key -1. A null text counts as empty. Repeated rows are separate rows
and take separate slots. An empty table gives an empty result. Further columns are ignored, also
such that bear the name of a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: multiplier of the published generator, key = key * MULTIPLIER + 1 modulo 2**64.
MULTIPLIER = 2862933555777941757

_M16, _M32 = 0xFFFF, 0xFFFFFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One step of the generator on a 64-bit key in two unsigned 32-bit halves, without overflow."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & _M32
    a, b = m_lo & _M16, m_lo >> 16
    p, q = lo * F.lit(a), lo * F.lit(b)
    low = p.bitwiseAND(F.lit(_M32)) + F.shiftleft(q.bitwiseAND(F.lit(_M16)), 16) + F.lit(1)
    carry = F.shiftright(p, 32) + F.shiftright(q, 16) + F.shiftright(low, 32)
    cross = hi * F.lit(a) + F.shiftleft((hi * F.lit(b)).bitwiseAND(F.lit(_M16)), 16)
    high = carry + (lo * F.lit(m_hi)).bitwiseAND(F.lit(_M32)) + cross
    return high.bitwiseAND(F.lit(_M32)), low.bitwiseAND(F.lit(_M32))


def jump_hash(key: Column, n_shards: int) -> Column:
    """The shard, 0 to ``n_shards`` - 1, of a bigint key; null counts as -1.

    Every jump goes to a higher shard, so ``n_shards`` steps always suffice; a finished key stays as it is.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_M32)).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        # the upper 31 bits of the key, plus one, against 2**31
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), j.alias("j"))
        return F.when(s["j"] < n_shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, jump, lambda s: s["b"]).cast("int")


def shard(docs: DataFrame, n_shards: int, key: str = "doc_id", sub_buckets: int = 256) -> DataFrame:
    """Adds ``shard``, ``grown_shard`` (with one shard more) and ``slot`` (gapless in the shard, from 0).

    A shard holds a fixed part of all rows, so its rows are not numbered in one task: they are
    numbered in ``sub_buckets`` parts by the row's hash, so that not even the rows of one key meet in one task, and each
    part starts where the counts of the parts before it end. The counts are at most ``n_shards * sub_buckets`` rows, whatever the input,
    so they are broadcast.
    """
    names = [c for c in docs.columns if c not in ("shard", "grown_shard", "slot", "__sub", "__base")]
    placed = docs.select(
        *names,
        jump_hash(F.col(key), n_shards).alias("shard"),
        jump_hash(F.col(key), n_shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(*[c for c, kind in docs.select(*names).dtypes if "map<" not in kind and kind != "variant"]), F.lit(sub_buckets)).cast("int").alias("__sub"),
    )
    before = W.partitionBy("shard").orderBy("__sub").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "__sub").agg(F.count("*").alias("n"))
    base = counts.select("shard", "__sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = W.partitionBy("shard", "__sub").orderBy(F.col(key), *[c for c in names if c != key])
    return (
        placed.withColumn("__at", F.row_number().over(inside) - 1)
        .join(F.broadcast(base), ["shard", "__sub"])
        .select(*names, "shard", "grown_shard", (F.col("__base") + F.col("__at")).cast("long").alias("slot"))
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` into 24 shards by doc_id (law ``key``)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(rows, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
