"""Ranked lexical search with the Best Position Algorithm (Akbarinia, Pacitti and Valduriez, VLDB 2007).

The index is a table of segments, as many documents each as about SEGMENT bytes of text hold: the documents' ids and lengths, and
for every term (by its 64-bit hash) the documents that hold it, with how often. It is written once, holds all terms and
all documents, and serves any items, numbers of results or weights; a segment needs nothing from another one.

A search reads the statistics of the whole index first. In a segment every term of an item has an impact list: its postings
in descending order of what they add to a score. Documents are read from each list by direct access to its best position,
the end of the contiguous run of positions seen so far; for every document found there, its places in all other
lists are looked up, which gives its whole score and marks these places as seen, so best positions jump ahead of what was read from a list. No unseen
document can score above the sum of the impacts at the first unseen positions. The search of a segment ends when this threshold is strictly below
the k-th score known, as a document of the same score may still come first by its id. A task carries its k best from segment to segment, so later segments end sooner.

Items are asked in blocks of a bounded number, paired with the segments by a join. Each task sends k rows an item.

Cases: a null or blank text has no terms, is no document of the statistics and is never found; an item without terms finds nothing. Rows that share
an item_id, null included, are one item with the terms of all. Repeated document rows are ranked each; documents without doc_id come after all others
of the same score. An empty table gives an empty result. Further columns are ignored, also such that bear the name of a result column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._bytes import ALNUM, buffers, chunks, codes, split_words
from ._work import in_arrow, small_side, stash, table

#: Bytes of text in a segment of the index; a longer text is a segment of its own.
SEGMENT = 4 << 20
#: Items in a block, and terms or blocks that are broadcast; beyond that they are joined by a shuffle.
BLOCK, BROADCAST_TERMS, BROADCAST_BLOCKS = 256, 1_000_000, 64
#: Positions that a list is read on in the first round and at most.
FIRST, MOST = 8, 2048
#: Scale of weights, impacts and length norms.
WEIGHT, IMPACT, TF, NORM = 1000, 1_000_000_000, 1000, 8

INDEX = "n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<long>, dfs array<long>, docs array<int>, tfs array<int>"


def _hashed(distinct: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, distinct.to_pylist()), dtype=np.uint64, count=len(distinct)).view(np.int64)


def _one(values, kind: pa.DataType) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of the index of ``docs`` (doc_id, text), to be written with ``stash``, as large rows."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        words = split_words(*buffers(rows["text"]), ALNUM)
        code, distinct = codes(words.words)
        hashed = _hashed(distinct)
        order = np.argsort(hashed, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        lengths = np.diff(words.first)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        posting, tf = np.unique((rank[code] if len(code) else code.astype(np.int64)) * max(1, len(lengths)) + doc, return_counts=True)
        term, doc = posting // max(1, len(lengths)), posting % max(1, len(lengths))
        cells = [(rows["doc_id"].combine_chunks(), pa.int64()), (lengths, pa.int64()), (hashed[order], pa.int64()), (np.bincount(term, minlength=len(order)), pa.int64()), (doc.astype(np.int32), pa.int32()), (tf.astype(np.int32), pa.int32())]
        counts = [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
        cells = [_one(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v, kind) for v, kind in cells]
        return pa.RecordBatch.from_arrays([*counts, *cells], [f.split()[0] for f in INDEX.split(", ")])

    def segments(batches):
        held, size = [], 0
        for whole in batches:
            for batch in chunks(whole, "text", SEGMENT):
                held.append(batch)
                size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
                if size >= SEGMENT:
                    yield made(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield made(pa.Table.from_batches(held))

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), segments, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct (item_id, term) of ``items`` (item_id, text)."""

    def terms(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                words = split_words(*buffers(batch.column("text")), ALNUM)
                code, distinct = codes(words.words)
                hashed = _hashed(distinct)[code] if len(code) else np.zeros(0, np.int64)
                which = np.repeat(np.arange(len(batch)), np.diff(words.first))
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(which)), pa.array(hashed, pa.int64())], ["item_id", "term"])

    kind = dict(items.dtypes)["item_id"]
    return in_arrow(items.select("item_id", "text"), terms, f"item_id {kind}, term long").distinct()


def weighted_terms(index: DataFrame, terms: DataFrame) -> tuple[DataFrame, int, int]:
    """(item_id, term, weight) of the terms that any document holds; the number of documents with a term, and of all their terms."""
    n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    wanted = stash(terms.select("term").distinct(), "terms")
    each = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    df = each.join(small_side(wanted, BROADCAST_TERMS), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(float(WEIGHT)) * F.log(F.lit(2.0 * (n or 0) + 2) / (F.col("df") * 2.0 + 1))).cast("long")
    return terms.join(small_side(stash(df, "frequencies"), BROADCAST_TERMS), "term").select("item_id", "term", weight.alias("weight")), n or 0, total or 0


class Lists:
    """The impact lists of a segment for the terms of a block of items."""

    def __init__(self, row: dict, wanted: np.ndarray, n: int, total: int):
        terms, dfs = row["terms"], row["dfs"]
        norm = 10 + 90 * row["lengths"] * n // total
        place = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        self.terms = wanted[terms[place] == wanted]
        place = place[terms[place] == wanted]
        size = dfs[place]
        self.at = np.concatenate([[0], np.cumsum(size)])
        first = (np.cumsum(dfs) - dfs)[place]
        posting = np.repeat(first - self.at[:-1], size) + np.arange(self.at[-1])
        doc, tf = row["docs"][posting].astype(np.int64), row["tfs"][posting].astype(np.int64)
        lists = np.repeat(np.arange(len(size)), size)
        self.keys = (lists << 32) | doc  # ascending
        self.impact = IMPACT * tf // (TF * tf + NORM * norm[doc])
        order = np.lexsort((doc, -self.impact, lists))
        self.by_impact, self.in_order = doc[order], self.impact[order]
        self.position = np.empty(len(order), dtype=np.int64)
        self.position[order] = np.arange(len(order)) - self.at[lists]
        self.n_docs = len(row["lengths"])

    def best(self, lists: np.ndarray, weights: np.ndarray, top: Top) -> None:
        """Adds to ``top`` the documents of this segment that may be among the k best."""
        start, length = self.at[lists], self.at[lists + 1] - self.at[lists]
        own = np.cumsum(length) - length  # where a list begins in ``seen``
        seen, known = np.zeros(int(length.sum()), dtype=bool), np.zeros(self.n_docs, dtype=bool)
        reached, step = np.zeros(len(lists), dtype=np.int64), FIRST
        while True:
            open_ = reached < length
            threshold = int((weights[open_] * self.in_order[(start + reached)[open_]]).sum())
            if threshold < max(top.least, 1):
                return
            n = np.minimum(step, length - reached)
            at = np.repeat(start + reached - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found = self.by_impact[at]
            fresh = np.unique(found[~known[found]])
            known[fresh] = True
            keys = ((lists[:, None] << 32) | fresh[None, :]).ravel()
            posting = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[posting] == keys
            scores = (np.where(hit, self.impact[posting], 0).reshape(len(lists), len(fresh)) * weights[:, None]).sum(axis=0)
            seen[np.repeat(own, len(fresh))[hit] + self.position[posting[hit]]] = True
            top.add(scores, fresh)
            for i in np.flatnonzero(open_):
                ahead = seen[own[i] + reached[i] : own[i] + length[i]]
                gap = int(ahead.argmin())
                reached[i] = length[i] if ahead[gap] else reached[i] + gap
            step = min(step * 2, MOST)


class Top:
    """The k best (score, doc_id) so far, a null id after all others."""

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.scores, self.ids, self.lacks = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def within(self, ids: np.ndarray, lacks: np.ndarray) -> Top:
        """Rows that ``add`` is given from now on are those of a segment with these ids."""
        self.own, self.own_lacks = ids, lacks
        return self

    def add(self, scores: np.ndarray, rows: np.ndarray) -> None:
        good = scores >= max(self.least, 1)
        scores = np.concatenate([self.scores, scores[good]])
        ids, lacks = np.concatenate([self.ids, self.own[rows[good]]]), np.concatenate([self.lacks, self.own_lacks[rows[good]]])
        keep = np.lexsort((ids, lacks, -scores))[: self.k]
        self.scores, self.ids, self.lacks = scores[keep], ids[keep], lacks[keep]
        self.least = int(self.scores[-1]) if len(self.scores) == self.k else 0


def _blocks(terms: DataFrame) -> tuple[DataFrame, int]:
    """The items of each block with their terms and weights, written; and the number of blocks."""
    items = stash(terms.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms")), "items")
    n = max(1, -(-items.count() // BLOCK))
    return stash(items.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("item_id", "terms")).alias("items")), "blocks"), n


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of a written ``index`` for each of ``items`` (item_id, text); equal scores by doc_id."""
    terms, n, total = weighted_terms(index, stash(item_terms(items), "item_terms"))
    blocks, n_blocks = _blocks(terms)
    kind, arrow_kind = dict(items.dtypes)["item_id"], to_arrow_type(items.schema["item_id"].dataType)

    def run(batches):
        tops: dict[int, tuple[pa.Array, list[Top]]] = {}
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].values for c in ("doc_ids", "lengths", "terms", "dfs", "docs", "tfs")}
                lacks = row["doc_ids"].is_null().to_numpy(zero_copy_only=False)
                ids = pc.fill_null(row.pop("doc_ids"), 0).to_numpy()
                row = {c: x.to_numpy() for c, x in row.items()}
                asked = batch.column("items")[i].values
                each = asked.field("terms")
                at = each.offsets.to_numpy()
                term, weight = (each.values.field(c).to_numpy() for c in ("term", "weight"))
                name = batch.column("block")[i].as_py()
                if name not in tops:
                    tops[name] = (asked.field("item_id"), [Top(k) for _ in range(len(asked))])
                if not len(row["terms"]):
                    continue
                lists = Lists(row, np.unique(term), n, total)
                if not len(lists.terms):
                    continue
                for j, top in enumerate(tops[name][1]):
                    own, w = term[at[j] : at[j + 1]], weight[at[j] : at[j + 1]]
                    place = np.minimum(np.searchsorted(lists.terms, own), len(lists.terms) - 1)
                    there = (lists.terms[place] == own) & (w > 0)
                    lists.best(place[there], w[there], top.within(ids, lacks))
        for names, each in tops.values():
            which = np.repeat(np.arange(len(each)), [len(t.scores) for t in each])
            none = np.zeros(0, np.int64)
            found = pa.array(np.concatenate([none, *(t.ids for t in each)]), pa.int64(), mask=np.concatenate([none.astype(bool), *(t.lacks for t in each)]))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(which)).cast(arrow_kind), found, pa.array(np.concatenate([none, *(t.scores for t in each)]), pa.int64())], ["item_id", "doc_id", "score"])

    paired = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(small_side(blocks, BROADCAST_BLOCKS), "block")
    best = in_arrow(paired.select("block", "items", "doc_ids", "lengths", "terms", "dfs", "docs", "tfs"), run, f"item_id {kind}, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each ``benchmark`` item."""
    index = stash(build_index(table(spark, sf_dir, "documents")), "index", large=True)
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = rf"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, rowid AS place, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents)
  UNION ALL
  SELECT 'i', item_id, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))
  FROM benchmark
),
tf AS (SELECT id AS doc_id, place, term, count(*) AS tf FROM words WHERE kind = 'd' GROUP BY ALL),
n AS (SELECT place, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY place),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
m AS (SELECT place, 10 + (90 * n * nn) // ll AS m FROM n, whole),
w AS (SELECT term, CAST(floor({WEIGHT} * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, whole GROUP BY term, nn),
asked AS (SELECT DISTINCT id AS item_id, term FROM words WHERE kind = 'i'),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * (({IMPACT} * tf) // ({TF} * tf + {NORM} * m))) AS BIGINT) AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (place) GROUP BY item_id, doc_id, place
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
