"""Packing of documents into training sequences: vector best-fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths).
A piece goes where it fits in all three and the residual capacity scores best: by the norm of the
residual that would be left (tight fit) or by the weighted dot product of piece and residual.

Pieces of equal length are alike, and lengths are whole numbers up to the capacity. So the longest-first
vector best-fit over all pieces of the corpus is computed from their histogram alone, which has a bounded
number of rows however many documents there are (and so has the plan: a few thousand intervals for lengths up to 1024): it gives intervals of ranks, "the pieces of length l
ranked from r on go into the sequences from s on, at offset o". Spark then ranks the pieces of each length
and joins the intervals. A frequent length is ranked in parts by a hash of the document, each of which
starts where the counts of the parts before it end.

Cases: a null or empty text is the end token alone; a document that occurs twice is packed twice; rows
without doc_id are packed like others; an empty table gives an empty result; further columns are
ignored, also such that bear the name of a result column.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._bpe import encoder
from ._bytes import chunks
from ._work import in_arrow, stash, table

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
#: Parts in which the pieces of one length are ranked.
PARTS = 128
#: Bytes of text encoded at a time; the arrays of a task take some forty times as much.
CHUNK = 1 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence and how residuals are scored.

    With the defaults all three residuals choose the sequence, but only the token capacity can be exceeded: pieces of one
    token and more that fit into it are at most ``tokens`` many and cost at most its square.
    """

    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY * CAPACITY
    score: str = "norm"  # or "dot"
    weights: tuple[float, float, float] = (1.0, 0.5, 0.5)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and the end token; a longer one is cut from its end."""

    def run(batches):
        encode = encoder(path).encode
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK):
                flat, at = encode(batch.column("text"))
                ids = np.full(len(flat) + len(batch), END, dtype="<u4")
                real = np.ones(len(ids), dtype=bool)
                real[at[1:] + np.arange(len(batch))] = False
                ids[real] = flat
                begin = at[:-1] + np.arange(len(batch))
                size = np.diff(at) + 1
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(batch)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = size - (n - 1) * capacity
                length = np.where(piece == 0, head[doc], capacity)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                lo = begin[doc] + start
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
                out = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(lo, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES + ", ids array<int>" * with_ids)


def best_fit(histogram: dict[int, int], limits: Limits = Limits()) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies, first sequence, offset) of longest-first vector best-fit.

    Sequences with the same content are held as one group with a count. A chosen group takes as many
    copies of a piece as fit, as the sequence just filled scores best again under "norm"; under "dot" it
    takes one, and the groups are scored anew.
    """
    cap = np.array([limits.tokens, limits.documents, limits.attention], dtype=np.float64)
    weight = np.array(limits.weights)
    left = np.zeros((0, 3))  # residual capacities of each group
    first, count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # its sequences
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length], dtype=np.float64)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits into no sequence")
        rank, todo = 0, int(histogram[length])
        while todo:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                if limits.score == "norm":
                    score = -(weight * ((left[fits] - need) / cap) ** 2).sum(axis=1)
                else:
                    score = (weight * (left[fits] / cap) * (need / cap)).sum(axis=1)
                g = fits[score.argmax()]
            else:
                copies = int((cap // need).min()) if limits.score == "norm" else 1
                new = -(-todo // copies)
                left, first, count = np.vstack([left, cap]), np.append(first, sequences), np.append(count, new)
                sequences += new
                g = len(count) - 1
            copies = int((left[g] // need).min()) if limits.score == "norm" else 1
            copies = min(copies, todo)
            bins = min(int(count[g]), todo // copies)
            out.append((length, rank, rank + bins * copies, copies, int(first[g]), int(limits.tokens - left[g, 0])))
            rank, todo = rank + bins * copies, todo - bins * copies
            filled = left[g] - copies * need
            if bins < count[g]:
                left, first, count = np.vstack([left, filled]), np.append(first, first[g]), np.append(count, bins)
                first[g] += bins
                count[g] -= bins
            else:
                left[g] = filled
            keep = (left >= 1).all(axis=1)
            left, first, count = left[keep], first[keep], count[keep]
    return out


def pack(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a stashed table of pieces."""
    spark = pieces.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).cast("int")
    counts = pieces.groupBy("length", part.alias("__part")).agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = stash(counts.select("length", "__part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")), "counts")
    histogram = {r[0]: r[1] for r in base.groupBy("length").agg(F.sum("n")).collect()}  # at most limits.tokens rows
    plan = spark.createDataFrame(best_fit(histogram, limits), "length long, r0 long, r1 long, copies long, s0 long, o0 long")
    w = W.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")
    # base has at most limits.tokens * PARTS rows; plan depends on the histogram only
    ranked = (
        pieces.withColumn("__part", part)
        .withColumn("__at", F.row_number().over(w) - 1)
        .join(F.broadcast(base.select("length", "__part", "__base")), ["length", "__part"])
        .withColumn("__rank", F.col("__base") + F.col("__at"))
    )
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("__rank") >= F.col("r0")) & (F.col("__rank") < F.col("r1")))
    within = F.col("__rank") - F.col("r0")
    return placed.select(
        *[pieces[c] for c in pieces.columns],
        (F.col("s0") + F.floor(within / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("o0") + F.pmod(within, F.col("copies")) * pieces["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, limits: Limits = Limits(), with_ids: bool = False) -> DataFrame:
    """All pieces of ``docs`` (doc_id, text) with their places."""
    return pack(stash(cut(docs, path or tokenizer_path(), limits.tokens, with_ids), "pieces"), limits)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed pieces of all documents left."""
    return pack_documents(docs)
