"""Mixing of sources to target weights by capped water-filling, in DataFrame functions only.

The words of all sources are shared out by weight. A source is repeated at most ``epochs`` times: where its share is
above that, it is clamped there, and what it leaves is shared out again among the others by weight, until no share is
above its cap. A source's target over its size is its number of repetitions: the whole ones take every document, the
fraction a seeded sample of documents, in the order of a hash until the words of the fraction are reached. The first
document that does not fit ends the sample; ``REFILLS`` more samples, of documents that fit, fill what it left.

Where a sample ends is found without sorting a source: its words are added up by the hash's first 12 bits, and only the documents of
the cell where the sample ends, one of 4,096, are put in order. What results is one row a source, so the documents themselves are
never shuffled, and a source that holds most of them is added up by all tasks.

Cases: a null text has no words; a document without words adds nothing, however often it is taken. A null source is a source of its
own. A row without doc_id takes part like any other. Rows with the same doc_id and text have the same hash and are taken
together or not at all. A source without words has a target of 0; if the caps do not reach all words, every source is at its cap.
An empty table gives an empty result. Further columns are kept by ``mix``, unless they bear the name of a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._work import stash, table

EPOCHS = 3
SEED = 12
#: Further samples, of the documents that still fit, after the first.
REFILLS = 2
#: Bits of the hash, and those by which a source's words are added up.
HASH_BITS, CELL_BITS = 60, 12
BROADCAST_SOURCES = 1_000_000

ADDED = ("size", "source_size", "target", "repeats", "taken")


def word_count(text: Column) -> Column:
    r"""The number of ``[^\x20\x09-\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_hash(seed: int, *parts: Column) -> Column:
    """60 bits of the md5 of the seed and the parts; a null part is a dash."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _cell() -> Column:
    return F.shiftright("hash", HASH_BITS - CELL_BITS)


def numbered(values: DataFrame, *order: Column) -> DataFrame:
    """Adds ``number``, from 0 in the given order. Rows are numbered in parts by range, so that no task holds all of them."""
    parts = stash(values.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "parts")
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a part
    base = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("number", inside).join(F.broadcast(base), "part").withColumn("number", (F.col("number") + F.col("base")).cast("long")).drop("part", "base")


def water_fill(sources: DataFrame, epochs: float = EPOCHS) -> DataFrame:
    """``sources`` (size, weight, ...; written) with ``target``: the shares of the sum of all sizes, none above ``epochs`` sizes.

    Each round clamps every source whose share of what is left is above its cap. A share of a unit of weight (the level) only grows
    from round to round, so it tells all clamped sources; three sums leave a round.
    """
    cap = F.col("size") * F.lit(float(epochs))
    clamped = lambda level: F.col("weight") * F.lit(level) > cap
    level, n = 0.0, -1
    while True:
        whole, used, weights, now = sources.agg(F.sum("size"), F.sum(F.when(clamped(level), cap)), F.sum(F.when(~clamped(level), F.col("weight"))), F.count_if(clamped(level))).first()
        if now == n or not weights:
            return sources.withColumn("target", F.when(clamped(level), cap).otherwise(F.col("weight") * F.lit(level)))
        level, n = (float(whole) - (used or 0.0)) / weights, now


def _join(rows: DataFrame, sources: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their source's row."""
    named = sources.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(named) if small else named, rows["source"].eqNullSafe(named["__source"]), how).drop("__source")


def sample_ends(rows: DataFrame, quotas: DataFrame, small: bool) -> DataFrame:
    """(source, cut, got): in the order of the hash, rows (source, size, hash) below ``cut`` have ``got`` <= ``quota`` words, and the
    next hash would pass it. ``cut`` is 2 ** 60 where all rows fit.
    """
    upto = lambda order: F.sum("size").over(W.partitionBy("source").orderBy(order).rangeBetween(W.unboundedPreceding, 0))
    fits = F.col("upto") <= F.col("quota")
    sums = _join(rows.groupBy("source", _cell().alias("cell")).agg(F.sum("size").alias("size")), quotas.select("source", "quota"), small).withColumn("upto", upto("cell"))
    cells = sums.groupBy("source", "quota").agg(F.min(F.when(~fits, F.col("cell"))).alias("cell"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("before"))
    cells = stash(cells, "cells")
    inside = _join(rows, cells, small).filter(_cell() == F.col("cell")).withColumn("upto", F.col("before") + upto("hash"))
    last = inside.groupBy("source").agg(F.min(F.when(~fits, F.col("hash"))).alias("cut"), F.max(F.when(fits, F.col("upto"))).alias("upto"))
    whole = F.lit(1 << HASH_BITS)
    return stash(_join(cells, last, small, "left").select("source", F.coalesce("cut", whole).alias("cut"), F.coalesce("upto", "before").alias("got")), "ends")


def plan(rows: DataFrame, weights: DataFrame, epochs: int = EPOCHS, refills: int = REFILLS) -> DataFrame:
    """One row a source of ``rows`` (source, size, hash; written) with a weight: source_size, target, whole, and the ``samples``' (quota, cut, after)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    given = weights.select(F.col("source").alias("__source"), F.col("weight").cast("double").alias("weight"))
    sizes = stash(sizes.join(given, sizes["source"].eqNullSafe(given["__source"])).drop("__source"), "sizes")
    small = sizes.count() <= BROADCAST_SOURCES
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    fraction = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    none = F.array().cast("array<struct<quota: long, cut: long, after: long>>")
    state = water_fill(sizes, epochs).select("source", F.col("size").alias("source_size"), "target", whole.alias("whole"))
    state = state.withColumns({"quota": F.when(F.col("source_size") > 0, fraction).otherwise(0), "after": F.lit(-1).cast("long"), "samples": none})
    for _ in range(refills + 1):
        left = state.filter("quota > 0").select("source", "quota", "after")
        fit = _join(rows, left, small).filter((F.col("size") > 0) & (F.col("size") <= F.col("quota")) & (F.col("hash") > F.col("after")))
        ends = sample_ends(fit.select("source", "size", "hash"), left, small)
        sample = F.when(F.col("cut").isNotNull(), F.array(F.struct("quota", "cut", "after"))).otherwise(none)
        after = {"samples": F.concat("samples", sample), "quota": F.col("quota") - F.coalesce("got", F.lit(0)), "after": F.coalesce("cut", "after")}
        state = stash(_join(state, ends, small, "left").withColumns(after).drop("cut", "got"), "sources")
    return state.drop("quota", "after")


def measured(docs: DataFrame, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (words) and ``hash``."""
    return docs.withColumns({"size": word_count(F.col(text)), "hash": seeded_hash(seed, F.col(key), F.col(text))})


def take(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (source, size, hash, ...) with source_size, target, repeats and taken by the ``sources`` of ``plan``; others are left out."""
    sampled = F.exists("samples", lambda x: (F.col("hash") > x["after"]) & (F.col("hash") < x["cut"]) & (F.col("size") <= x["quota"]))
    out = _join(rows, sources, sources.count() <= BROADCAST_SOURCES).withColumn("repeats", (F.col("whole") + sampled.cast("long")).cast("int"))
    return out.withColumn("taken", F.col("repeats") * F.col("size")).drop("samples", "whole")


def mix(docs: DataFrame, weights: DataFrame, epochs: int = EPOCHS, seed: int = SEED, refills: int = REFILLS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, repeats (how often the mix takes the document) and taken (its words in the mix).

    weights: source, weight (positive). A source that it lacks takes no part, and its rows are left out. ``repeated`` gives the mix.
    """
    rows = measured(docs.select(F.struct(*[c for c in docs.columns if c not in ADDED]).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source")), seed, "key", "text")
    sources = plan(stash(rows.select("source", "size", "hash"), "sizes"), weights, epochs, refills)
    return take(rows, sources).select("row.*", *ADDED)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix: every document of ``mix`` as often as it says, with ``copy`` (from 1)."""
    return mixed.filter("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))


def op12_source_mixing(spark, sf_dir: str) -> DataFrame:
    """All ``documents``; the sources in code-point order, null last, weigh 1, 2, 3, 1, and so on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = stash(measured(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "hash"), "measured")
    weights = numbered(rows.select("source").distinct(), F.col("source").asc_nulls_last()).select("source", (F.col("number") % 3 + 1).alias("weight"))
    return take(rows, plan(rows, weights)).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def _sample_sql(k: int) -> str:
    """The k-th sample: rows that are not taken, come after the last sample's end and fit, in the order of the hash."""
    return f"""
f{k} AS (SELECT r.doc_id, r.hash, r.size, r.source, q.quota, sum(r.size) OVER (PARTITION BY r.source ORDER BY r.hash RANGE UNBOUNDED PRECEDING) AS upto
         FROM rows r JOIN q{k} q ON r.source IS NOT DISTINCT FROM q.source WHERE q.quota > 0 AND r.size > 0 AND r.size <= q.quota AND r.hash > q.after),
t{k} AS (SELECT DISTINCT source, hash FROM f{k} WHERE upto <= quota),
e{k} AS (SELECT source, coalesce(min(hash) FILTER (upto > quota), {1 << HASH_BITS}) AS cut, coalesce(sum(size) FILTER (upto <= quota), 0) AS got FROM f{k} GROUP BY source),
q{k + 1} AS (SELECT q.source, q.quota - coalesce(e.got, 0) AS quota, coalesce(e.cut, q.after) AS after FROM q{k} q LEFT JOIN e{k} e ON q.source IS NOT DISTINCT FROM e.source)"""


OP12_SQL = rf"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(text, '-')), 1, {HASH_BITS // 4}) AS BIGINT) AS hash
  FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM rows GROUP BY source),
l AS (
  SELECT *, ((SELECT sum(size) FROM s) - coalesce(sum({EPOCHS} * size) OVER (ORDER BY size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s
),
w AS (SELECT arg_min(level, (size / weight, source)) FILTER (weight * level <= {EPOCHS} * size) AS level FROM l),
g AS (SELECT source, l.size, CASE WHEN weight * w.level > {EPOCHS} * l.size THEN {EPOCHS}.0::DOUBLE * l.size ELSE weight * w.level END AS target FROM l, w),
q0 AS (SELECT source, CAST(round(target - floor(target / size) * size) AS BIGINT) AS quota, -1::BIGINT AS after FROM g WHERE size > 0),{",".join(_sample_sql(k) for k in range(REFILLS + 1))},
taken AS ({" UNION ".join(f"SELECT source, hash FROM t{k}" for k in range(REFILLS + 1))})
SELECT r.doc_id, r.size, g.size AS source_size, g.target, r.source, CAST(n AS INT) AS repeats, CAST(n * r.size AS BIGINT) AS taken
FROM (SELECT rows.*, CASE WHEN g.size > 0 THEN floor(g.target / g.size) ELSE 0 END + CASE WHEN t.hash IS NULL THEN 0 ELSE 1 END AS n
      FROM rows JOIN g ON rows.source IS NOT DISTINCT FROM g.source LEFT JOIN taken t ON rows.source IS NOT DISTINCT FROM t.source AND rows.hash = t.hash) r
JOIN g ON r.source IS NOT DISTINCT FROM g.source
"""
