"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments, as many documents each as about 4 MB of text hold: the documents'
ids, and for every term the ascending list of its positions. It is written once and searched in
parallel; a segment never needs another one, so nothing is shuffled.

Phrase search in a segment: a phrase starts from the list of its rarest term, less that term's offset
in the phrase, and the lists of its other terms, less theirs, are intersected with it in the order of
rarity. Proximity search wants all the words of a phrase within a span, in any order.

A benchmark is cut into slices of a bounded number of words; one slice at a time is sent to the tasks.
If there is one slice only, the index keeps just its terms.

Cases: null or word-less texts have no words, and null or word-less items no phrases; an item that
occurs twice counts once; a repeated document row is a row of its own; an empty table gives an empty
result, an empty benchmark no hits. Further columns are ignored, also such that bear the name of a
result column.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import ALNUM, buffers, chunks, codes, split_words
from ._work import in_arrow, row_key, small_side, stash, table

WINDOW = 10
#: The words of a phrase are near each other if they lie in so many consecutive words.
SPAN = 2 * WINDOW
#: Words of the benchmark in a slice; what a task holds of it is bounded by this.
SLICE_WORDS = 1_000_000
#: Phrases whose lists are intersected at a time.
BLOCK = 2048
BROADCAST_IDS = 2_000_000

INDEX = "doc_ids array<long>, first array<int>, terms array<binary>, term_at array<int>, positions array<int>"
RESULT = "segment long, place int, doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>, near_items array<string>"


class Phrases:
    """Distinct windows of a slice of items: a row of term numbers each, -1 beyond its end."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        words = split_words(*buffers(pa.array([t for _, t in items], pa.large_string())), ALNUM)
        code, self.terms = codes(words.words)
        found: dict[bytes, set[str]] = {}
        for (item, _), at, to in zip(items, words.first[:-1], words.first[1:], strict=True):
            own = code[at:to].astype(np.int32)
            for i in range(max(1, len(own) - size + 1) if len(own) else 0):
                found.setdefault(own[i : i + size].tobytes(), set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.rows = np.full((len(found), size), -1, dtype=np.int64)
        for row, key in zip(self.rows, found, strict=True):
            own = np.frombuffer(key, dtype=np.int32)
            row[: len(own)] = own


def slices(benchmark: DataFrame, limit: int = SLICE_WORDS) -> Iterator[list[tuple[str, str]]]:
    """Consecutive (item_id, text) of about ``limit`` words each; holds one slice at a time."""
    rows, words = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        rows.append((r[0], r[1]))
        words += len(r[1]) // 2 + 1
        if words >= limit:
            yield rows
            rows, words = [], 0
    if rows:
        yield rows


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def build_index(docs: DataFrame, terms: pa.Array | None = None) -> DataFrame:
    """Segments of the positional index of ``docs`` (doc_id, text), of the given terms or all.

    Positions count words through the segment, with a gap of one after each document, so that no phrase
    can cross two of them.
    """

    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def segments(batches):
        terms = sent.value
        for whole in batches:
            for batch in chunks(whole, "text"):
                words = split_words(*buffers(batch.column("text")), ALNUM)
                term, distinct = codes(words.words)
                at = np.arange(len(term)) + np.repeat(np.arange(len(batch)), np.diff(words.first))
                if terms is not None:
                    known = pc.index_in(distinct, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
                    term = known[term] if len(term) else term
                    at, term, distinct = at[term >= 0], term[term >= 0], terms
                order = np.argsort(term, kind="stable")
                count = np.bincount(term, minlength=len(distinct))
                there = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column("doc_id")),
                        _list(words.first + np.arange(len(batch) + 1), pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, len(there)], pa.int32()), distinct.cast(pa.binary()).take(pa.array(there))),
                        _list(np.concatenate([[0], np.cumsum(count[there])]), pa.int32()),
                        _list(at[order], pa.int32()),
                    ],
                    ["doc_ids", "first", "terms", "term_at", "positions"],
                )

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), segments, INDEX).withColumn("segment", F.monotonically_increasing_id())


class Segment:
    """One row of the index, ready to be searched for the phrases of a slice."""

    def __init__(self, row: dict, phrases: Phrases):
        self.phrases, self.first = phrases, row["first"].astype(np.int64)
        self.at, self.positions = row["term_at"], row["positions"].astype(np.int64)
        own = pc.index_in(phrases.terms.cast(pa.binary()), value_set=row["terms"]).fill_null(-1).to_numpy(zero_copy_only=False)
        self.term = np.append(own, -2)  # -2: beyond a phrase's end
        count = np.append(np.diff(self.at), 0)
        self.count = np.where(self.term >= 0, count[self.term], 0)
        self.count[-1] = np.iinfo(np.int64).max  # the end comes last in the order of rarity
        lists = np.repeat(np.arange(len(self.at) - 1, dtype=np.int64), np.diff(self.at))
        self.keys = (lists << 32) | self.positions

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Phrases all of whose terms occur here, their terms' offsets from the rarest on, and how many are left."""
        rows = self.phrases.rows
        live = np.flatnonzero((self.count[rows] > 0).all(axis=1))
        for i in range(0, len(live), BLOCK):
            some = live[i : i + BLOCK]
            yield some, np.argsort(self.count[rows[some]], axis=1, kind="stable"), (rows[some] >= 0).sum(axis=1)

    def rarest(self, some: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into some, position) for each posting of each phrase's rarest term."""
        term = self.term[self.phrases.rows[some, offset]]
        n = self.at[term + 1] - self.at[term]
        which = np.repeat(np.arange(len(some)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.positions[self.at[term][which] + inside]

    def exact(self) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start position) of every occurrence."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for some, order, n in self.blocks():
            which, start = self.rarest(some, order[:, 0])
            start = start - order[which, 0]
            for k in range(1, order.shape[1]):
                offset = order[which, k]
                key = (self.term[self.phrases.rows[some[which], offset]].astype(np.int64) << 32) | (start + offset)
                found = np.searchsorted(self.keys, key)
                hit = (k >= n[which]) | ((start + offset >= 0) & (self.keys[np.minimum(found, len(self.keys) - 1)] == key))
                which, start = which[hit & (start >= 0)], start[hit & (start >= 0)]
            out.append((some[which], start))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def near(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position of its rarest word) where all its words lie within ``span`` positions."""
        out, rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], self.phrases.rows
        for some, order, n in self.blocks():
            which, at = self.rarest(some, order[:, 0])
            for k in range(1, order.shape[1]):
                term = self.term[rows[some[which], order[which, k]]].astype(np.int64)
                low = (term << 32) | np.maximum(at - span + 1, 0)
                found = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
                hit = (k >= n[which]) | ((self.keys[found] >> 32 == term) & (self.keys[found] & 0xFFFFFFFF < at + span))
                which, at = which[hit], at[hit]
            keep = np.concatenate([self._fit(rows[some[w]], p, span) for w, p in _cuts(which, at)] or [np.zeros(0, bool)])
            out.append((some[which][keep], at[keep]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _fit(self, rows: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
        """Is there, around each position, a span of its document with every term of its phrase? Tries all starts of a span at once."""
        doc = np.searchsorted(self.first, at, "right") - 1
        start, end = at[:, None] - np.arange(span), self.first[doc + 1][:, None]
        fits = start >= self.first[doc][:, None]
        for term in self.term[rows].astype(np.int64).T:
            low = (term[:, None] << 32) | np.maximum(start, 0)
            found = self.keys[np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)]
            fits &= (term[:, None] < 0) | ((found >= low) & (found < (term[:, None] << 32) + np.minimum(start + span, end)))
        return fits.any(axis=1)


def _cuts(*arrays: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    for i in range(0, len(arrays[0]), BLOCK):
        yield tuple(a[i : i + BLOCK] for a in arrays)


def search(index: DataFrame, phrases: Phrases, near: bool = True, span: int = SPAN) -> DataFrame:
    """One row per document: its place in the index, its words, the words inside an occurrence of a phrase, these items, the
    merged spans (word numbers, half-open), and the items of which a phrase's words are near each other.
    """

    sent = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i].values for n in batch.schema.names if n != "segment"}
                yield _search_segment(row, batch.column("segment")[i].as_py(), sent.value, near, span)

    return in_arrow(index, run, RESULT)


def _search_segment(row: dict, segment: int, phrases: Phrases, near: bool, span: int) -> pa.RecordBatch:
    row = {k: v if k in ("doc_ids", "terms") else v.to_numpy(zero_copy_only=False) for k, v in row.items()}
    first, n_docs = row["first"].astype(np.int64), len(row["doc_ids"])
    items: list[set] = [set() for _ in range(n_docs)]
    close: list[set] = [set() for _ in range(n_docs)]
    marks = np.zeros(first[-1] + 1, dtype=np.int64)
    if len(row["terms"]) and len(phrases.rows):
        seg = Segment(row, phrases)
        found, start = seg.exact()
        np.add.at(marks, start, 1)
        np.add.at(marks, start + (phrases.rows[found] >= 0).sum(axis=1), -1)
        doc = np.searchsorted(first, start, "right") - 1
        for x in np.unique(doc * len(phrases.rows) + found).tolist():
            items[x // len(phrases.rows)].update(phrases.items[x % len(phrases.rows)])
        if near:
            found, at = seg.near(span)
            doc = np.searchsorted(first, at, "right") - 1
            for x in np.unique(doc * len(phrases.rows) + found).tolist():
                close[x // len(phrases.rows)].update(phrases.items[x % len(phrases.rows)])
    hit = np.cumsum(marks) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(first, begin, "right") - 1
    spans: list[list] = [[] for _ in range(n_docs)]
    for d, b, e in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True):
        spans[d].append({"start": b - int(first[d]), "end": e - int(first[d])})
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n_docs, segment), pa.int64()),
            pa.array(np.arange(n_docs), pa.int32()),
            row["doc_ids"],
            pa.array(np.diff(first) - 1, pa.int64()),
            pa.array(total[first[1:]] - total[first[:-1]], pa.int64()),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array([sorted(x) for x in close], pa.list_(pa.string())),
        ],
        [f.split()[0] for f in ("segment", "place", "doc_id", "n_words", "n_hit", "items", "spans", "near_items")],
    )


def find(docs: DataFrame, benchmark: DataFrame, near: bool = True) -> DataFrame:
    """Contamination of every row of ``docs``; see ``search``. The index is written and then searched."""
    parts = slices(benchmark)
    one = next(parts, [])
    two = next(parts, None)
    phrases = Phrases(one)
    index = stash(build_index(docs, phrases.terms if two is None else None), "index")
    if two is None:
        return search(index, phrases, near).drop("segment", "place")
    found = [stash(search(index, phrases, near), "found"), stash(search(index, Phrases(two), near), "found")]
    found += [stash(search(index, Phrases(x), near), "found") for x in parts]
    return merge(reduce(DataFrame.unionByName, found))


def merge(found: DataFrame) -> DataFrame:
    """Joins the results of several slices, one row per place in the index and slice: a repeated document row stays a row of its own.

    Spans of several slices are merged in order of their start; each adds what lies beyond the furthest end so far.
    """
    flat = F.array_sort(F.flatten(F.collect_list("spans")))
    grown = F.aggregate(
        flat,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["start"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")),
        lambda s: s["n"].cast("long"),
    )
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return found.groupBy("segment", "place").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), grown.alias("n_hit"), union("items").alias("items"), flat.alias("spans"), union("near_items").alias("near_items")
    ).drop("segment", "place")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return find(docs, bench).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without any benchmark phrase. Rows without doc_id are told apart by their texts."""
    rows = docs.select(F.struct("*").alias("document"), row_key(F.col("doc_id"), F.col("text")).alias("doc_id"), "text")
    found = find(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), near=False)
    gone = stash(found.filter("n_hit > 0").select("doc_id").distinct(), "contaminated")
    return rows.join(small_side(gone, BROADCAST_IDS), "doc_id", "left_anti").select("document.*")
