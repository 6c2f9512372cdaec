"""Near-duplicate groups: circulant MinHash, banding, and exact Jaccard verification.

Signature (C-MinHash, Li and Li 2022): a first permutation scatters the shingles of a document over
0..D-1; a second permutation, shifted circularly by k, gives coordinate k as a minimum. Two
permutations so give all coordinates, and those of one shingle are neighbours in memory.

Search: documents with equal shingle sets are one class. Class representatives that agree in a band
meet in its bucket. No bucket is expanded into all its pairs:

1. every member is paired with its bucket's hub only, the member that meets the most documents in all its
   buckets; these pairs are verified on full sets, and what is linked forms components;
2. a pair inside a component can no longer change the result. A bucket that still joins several
   components is resolved exactly: a small one by the pairs between its components, a large one by a
   prefix filter with positions: sets of the wanted similarity share one of their rarest shingles, and
   from the first shared one on enough shingles must be left in both.

Then the links give the final components. A pair of Jaccard 0.75 shares none of the 32 bands of 4
coordinates with a probability of 5e-6; nothing else can lose a link.

Cases: a null or blank text has no shingles and is linked with nothing; rows that share a doc_id are
one document, linked if any of its rows is; a row without doc_id stays alone, with a null component,
and is kept; an empty table gives an empty result. Shingles are compared by 64-bit hashes. Further
columns are ignored, also such that bear the name of a result column.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import NOT_SPACE, buffers, chunks, hashes, mix, split_words
from ._work import in_arrow, most_frequent, row_key, small_side, stash, table

SHINGLE = 5
THRESHOLD = 75  # percent
BANDS, ROWS = 32, 4
UNIVERSE_BITS = 20
SEED = 20220
#: A bucket of up to so many documents is resolved by pairs between its components, a larger one by prefixes.
SMALL_BUCKET = 32
#: Frequent shingles that the tasks of the prefix filter know.
COMMON = 1 << 17
#: Lists of document numbers are broadcast up to so many rows and joined by a shuffle beyond that.
BROADCAST_IDS = 2_000_000

#: Bytes of text whose shingles a task makes at a time.
CHUNK = 2 << 20

SETS = "doc_id long, shingles array<long>"
SIGNATURES = "doc_id long, n_shingles long, set_key binary, bands array<long>"


@cache
def permutations(bits: int = UNIVERSE_BITS, seed: int = SEED, width: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation; the second as rows of ``width`` consecutive values, wrapped around its end."""
    rng = np.random.default_rng(seed)
    first, second = rng.permutation(1 << bits).astype(np.uint32), rng.permutation(1 << bits).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: width - 1]]), width)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k is the least of second[(first[x] + k) mod D] over the shingles x."""
    first, second = permutations()
    at = first[shingles & np.uint64((1 << UNIVERSE_BITS) - 1)]
    low = second[at[:4096]].min(axis=0)
    for i in range(4096, len(at), 4096):  # bounds the memory for a long text
        np.minimum(low, second[at[i : i + 4096]].min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, of its number and its coordinates."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1))
    return keys


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one shingle, of all of them."""
    words = split_words(*buffers(column), NOT_SPACE)
    h = hashes(words.words)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64))
    n = max(0, len(h) - size + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        rolled += h[j : j + n] * factors[j]
    rolled = mix(rolled)
    out = []
    for at, to in zip(words.first[:-1], words.first[1:], strict=True):
        if to - at >= size:
            out.append(np.unique(rolled[at : to - size + 1]))
        elif to > at:
            out.append(np.array([xxhash.xxh64_intdigest(h[at:to].tobytes(), seed=int(to - at))], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _signatures(batches):
    none = np.zeros(0, np.uint64)
    for whole in batches:
        for batch in chunks(whole, "text", CHUNK):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    _lists([band_keys(signature(s)) if len(s) else none for s in sets]),
                ],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )


def _sets(batches):
    for whole in batches:
        for batch in chunks(whole, "text", CHUNK):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(shingle_sets(batch.column("text")))], ["doc_id", "shingles"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    A pair comes once for each pair of its rows, if documents have several; dropping those here would keep
    the rows of a hub together in one task.
    """
    left = sets.join(small_side(pairs, BROADCAST_IDS), sets["doc_id"] == pairs["a"]).select("a", "b", F.col("shingles").alias("sa"))
    wanted = small_side(stash(pairs.select(F.col("b").alias("id")).distinct(), "ids"), BROADCAST_IDS)
    right = sets.join(wanted, sets["doc_id"] == wanted["id"], "left_semi").select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    low, high = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    similar = (low * 100 >= high * percent) & (both * 100 >= (F.size("sa") + F.size("sb") - both) * percent)
    return left.join(right, "b").filter(similar).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every linked document: the smallest document reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014); every step is written, so that
    the lineage stays short, and the loop ends when a round changes nothing. The least neighbours are
    written before they are joined: then the join has two plain sides, and a large one that holds most links
    of one node can be split.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
    was = mark(edges)
    while was[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(large.distinct(), "large")
        low = stash(edges.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stash(small.filter("u > v").distinct(), "edges")
        now = mark(edges)
        if now == was:
            break
        was = now
    roots = edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).union(roots)


def _common(batches):
    """(s, n) of shingles that occur twice or more in a batch of sets."""
    for batch in batches:
        s, n = np.unique(batch.column("shingles").flatten().to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(s[n > 1]), pa.array(n[n > 1])], ["s", "n"])


def prefix_pairs(sets: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """Candidate pairs between components among ``sets`` (doc_id, shingles, c): an exact prefix filter with positions.

    All sets are ordered alike. Sets of n shingles that are ``percent`` similar to another share one of their
    first n - ceil(percent*n/100) + 1. Where two sets first meet, they have at most as many shingles in common
    as are left in either. This holds in any order; the best puts frequent shingles last, so those that
    repeat within the batches of all sets are counted, and the COMMON most frequent sent to the tasks.
    """
    counts = stash(in_arrow(sets, _common, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")), "common")
    common = most_frequent(counts, "n", COMMON).toArrow().sort_by("s")
    sent = sets.sparkSession.sparkContext.broadcast((np.append(common["s"].to_numpy(), np.iinfo(np.int64).max), np.append(common["n"].to_numpy(), 0)))

    def prefixes(batches):
        keys, often = sent.value
        for batch in batches:
            own, places = [], []
            for s in batch.column("shingles"):
                s = s.values.to_numpy(zero_copy_only=False)
                at = np.searchsorted(keys, s)
                n = np.where(keys[at] == s, often[at], 0)
                k = len(s) - -(-percent * len(s) // 100) + 1
                own.append(s[np.lexsort((s, n))[:k]])
                places.append(len(s) - np.arange(k))
            size = [len(x) for x in own]
            which = pa.array(np.repeat(np.arange(len(own)), size))
            whole = pa.array(np.repeat([len(s.values) for s in batch.column("shingles")], size), pa.int32())
            none = [np.zeros(0, np.int64)]
            left, s = pa.array(np.concatenate(places or none), pa.int32()), pa.array(np.concatenate(own or none))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(which), batch.column("c").take(which), whole, left, s], ["doc_id", "c", "n", "left", "s"])

    prefix = stash(in_arrow(sets, prefixes, "doc_id long, c long, n int, left int, s long"), "prefixes")
    side = lambda k: prefix.select(F.col("doc_id").alias(k), F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("left").alias(f"left{k}"), "s")
    enough = F.least("lefta", "leftb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return side("a").join(side("b"), "s").filter(enough & (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b"))).select("a", "b").distinct()


def group(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sign = stash(in_arrow(docs, _signatures, SIGNATURES), "signatures")
    linked = sign.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stash(linked.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    member = stash(linked.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "rep"), "members")
    reps = member.filter("doc_id = rep").select("doc_id").distinct()
    entries = linked.join(reps, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band"))
    # what is joined by band is written first, so that a frequent band's join has two plain sides and can be split
    shared = stash(entries.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    buckets = stash(entries.join(shared, "band"), "buckets")
    meets = buckets.groupBy("doc_id").agg(F.sum("size").alias("meets"))
    hubs = stash(buckets.join(meets, "doc_id").groupBy("band").agg(F.max_by("doc_id", F.struct("meets", -F.col("doc_id"))).alias("hub")), "hubs")
    stars = stash(buckets.join(hubs, "band").filter("doc_id != hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct(), "stars")

    ids = stash(buckets.select(F.col("doc_id").alias("id")).distinct(), "ids")
    wanted = small_side(ids, BROADCAST_IDS)
    sets = stash(in_arrow(docs.join(wanted, docs["doc_id"] == wanted["id"], "left_semi"), _sets, SETS), "sets")

    copies = member.filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = stash(verify(stars, sets), "links")
    found = stash(components(links), "labels")

    labels = ids.join(found, ids["id"] == found["doc_id"], "left").select("id", F.coalesce("component_id", "id").alias("c"))
    labels = stash(labels, "labels")
    open_ = buckets.join(labels, buckets["doc_id"] == labels["id"]).select("band", "doc_id", "size", "c")
    mixed = open_.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("band")
    mixed = stash(mixed, "mixed")
    open_ = stash(open_.join(mixed, "band", "left_semi"), "open")
    few = open_.filter(F.col("size") <= SMALL_BUCKET)
    pairs = few.select("band", F.col("doc_id").alias("a"), F.col("c").alias("ca")).join(few.select("band", F.col("doc_id").alias("b"), F.col("c").alias("cb")), "band")
    rest = pairs.filter("a < b AND ca != cb").select("a", "b").distinct()
    many = stash(open_.filter(F.col("size") > SMALL_BUCKET).select("doc_id", "c").distinct(), "many")
    if many.limit(1).count():
        rest = rest.union(prefix_pairs(sets.join(small_side(many, BROADCAST_IDS), "doc_id").select("doc_id", "shingles", "c")))
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stash(rest.distinct().join(known, ["a", "b"], "left_anti"), "rest")

    final = stash(components(links.union(verify(rest, sets)).union(copies)), "components")
    return sign.select("doc_id", "n_shingles").join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return group(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group, its smallest doc_id; of exact repeats of a row one stays.

    Rows without doc_id are told apart by their texts and give way to rows with one.
    """
    rows = docs.select(F.struct("*").alias("document"), row_key(F.col("doc_id"), F.col("text")).alias("doc_id"), "text")
    found = stash(group(rows), "groups")
    gone = stash(found.filter("doc_id != component_id").select("doc_id").distinct(), "gone")
    repeated = stash(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    left = rows.join(small_side(gone, BROADCAST_IDS), "doc_id", "left_anti")
    if repeated.limit(1).count():
        once = left.join(small_side(repeated, BROADCAST_IDS), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(small_side(repeated, BROADCAST_IDS), "doc_id", "left_anti").unionByName(once)
    return left.select("document.*")
