"""Upkeep of the memory table: similarity links, topics, confidence, decay, reports, profile."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimscan.functions.work import in_arrow, in_blocks, packed, paired, small_side, stash
from claimscan.operators.search import base_stability, build_index, occurrences_of, phrase_blocks, vectors

# Types of links, relations, categories of profiles.
LINK_TYPES = ["related_to", "contradicts", "refines", "supersedes", "caused_by"]
RELATIONS = ["caused_by", "led_to", "resolved", "contradicts", "supersedes"]
CATEGORIES = ["identity", "skills", "preferences", "tools", "efficiency", "projects"]
#: Vectors in a block of the similarity grid; a task holds two blocks.
BLOCK = 4096
#: Vectors that a task of it reads of either side, and rows of a block that are multiplied at a time.
DEALT, ROWS = 65_536, 512
#: Vectors in a cell of the pruned search; vectors that centroids are taken from; centroids of a part; vectors on which the recall of cells is tried.
CELL, SAMPLE, MOST_CENTROIDS, PROBES = 32, 16_384, 4096, 2000
#: Topics in a block, vectors in a block that it is compared with, and blocks of topics that are broadcast; more are joined by a shuffle.
TOPIC_BLOCK, PACK, BROADCAST_BLOCKS = 2048, 4096, 64
#: Deltas that a task of a fold puts in order; memories, first by key, in which words are looked for before all are; memories of words that a task of a fold knows.
PART, FIRST, KNOWN = 500_000, 10_000, 100_000


# --- links ----------------------------------------------------------------------------------------


def common_dimension(df: DataFrame, col: str = "embedding") -> int | None:
    """The commonest length of the vectors, the greater of equals; None without any."""
    first = df.filter(F.col(col).isNotNull()).groupBy(F.size(col).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return None if first is None else first["dim"]


def _meet(dim: int, threshold: float):
    """For rows (x, y, b, fresh, key, embedding): the pairs of a row with b = x and one with b = y, one of them fresh, that are similar enough, in both orders."""

    def meet(table: pa.Table) -> pa.Table:
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        b, fresh = table["b"].to_numpy(), table["fresh"].to_numpy(zero_copy_only=False)
        keys = table["key"].to_pylist()
        m, at = vectors(table["embedding"], dim)
        left, right = at[b[at] == x], at[b[at] == y]
        a = m[b[at] == x]
        c = a if x == y else m[b[at] == y]
        s = a @ c.T
        i, j = np.nonzero((s >= threshold) & (fresh[left][:, None] | fresh[right][None, :]))
        if x == y:
            i, j = i[i < j], j[i < j]
        out = [(keys[left[p]], keys[right[q]], float(s[p, q])) for p, q in zip(i, j, strict=True) if keys[left[p]] != keys[right[q]]]
        out += [(q, p, v) for p, q, v in out]
        return pa.table({"key": pa.array([o[0] for o in out], table["key"].type), "other": pa.array([o[1] for o in out], table["key"].type), "strength": pa.array([o[2] for o in out], pa.float64())})

    return meet


def _block_pairs(b: str, blocks: Column) -> Column:
    """Every pair of blocks that block ``b`` is part of."""
    return F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.struct(F.least(F.col(b), o).alias("x"), F.greatest(F.col(b), o).alias("y")))


def _rows(df: DataFrame, new: DataFrame | None) -> DataFrame:
    """(key, embedding, fresh): all rows of ``df`` are fresh, or, with ``new``, only the rows of that."""
    own = df.select("key", "embedding", F.lit(new is None).alias("fresh"))
    return own if new is None else own.unionByName(new.select("key", "embedding", F.lit(True).alias("fresh")))


def similar_pairs(df: DataFrame, threshold: float = 0.85, block: int = BLOCK, dim: int | None = None, new: DataFrame | None = None) -> DataFrame:
    """Ordered pairs (key, other, strength) of different keys whose unit vectors have a dot product of at least ``threshold``.

    The vectors are dealt by hash and written once, in blocks of ``block``. A task reads two parts of this table (a cartesian product, so nothing is shuffled however
    many blocks meet), and compares a block of the one with a block of the other at a time;
    only the pairs found are emitted. No pair is computed twice; both orders are emitted. Vectors whose length is not ``dim``
    (by default the commonest of the table) are left out. With ``new`` (rows that come to ``df``) only pairs with one of these are found.
    """
    dim = common_dimension(df if new is None else df.unionByName(new, True)) if dim is None else dim
    rows = _rows(df, new)
    n, cores = rows.count(), df.sparkSession.sparkContext.defaultParallelism
    key, kind = dict(df.dtypes)["key"], np.float32 if dict(rows.dtypes)["embedding"] == "array<float>" else np.float64
    width = dim or 0

    def pack(batches):
        for whole in batches:
            m, at = vectors(whole.column("embedding"), width)
            for a in range(0, len(at), block):
                some = pa.array(at[a : a + block])
                one = pa.array([0, len(some)], pa.int32())
                lists = [pa.ListArray.from_arrays(one, whole.column(c).take(some)) for c in ("key", "fresh")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([m[a : a + block].astype(kind).tobytes()], pa.large_binary())], ["keys", "fresh", "m"])

    dealt = rows.repartition(max(1, math.ceil(n / DEALT), min(cores, math.ceil(n / block))), "key")
    packs = in_arrow(dealt, pack, f"keys array<{key}>, fresh array<boolean>, m binary").withColumn("b", F.monotonically_increasing_id())
    packs = stash(packs, "blocks", large=True)
    left, right = (packs.select(*[F.col(c).alias(f"{c}{side}") for c in packs.columns]) for side in "xy")
    pairs = left.join(right.hint("shuffle_replicate_nl"), F.col("bx") <= F.col("by"))

    def meet(batches):
        for batch in batches:
            for i in range(len(batch)):
                x, y = ([batch.column(f"{c}{side}")[i] for c in ("keys", "fresh", "m")] for side in "xy")
                own, other = x[0].values, y[0].values
                a, c = (np.frombuffer(s[2].as_buffer(), dtype=kind).reshape(-1, width).astype(np.float64) for s in (x, y))
                fresh, also = (s[1].values.to_numpy(zero_copy_only=False) for s in (x, y))
                same = batch.column("bx")[i].as_py() == batch.column("by")[i].as_py()
                for at in range(0, len(a), ROWS):
                    s = a[at : at + ROWS] @ c.T
                    p, q = np.nonzero((s >= threshold) & (fresh[at : at + ROWS, None] | also[None, :]))
                    p, q = (p[p + at < q], q[p + at < q]) if same else (p, q)
                    one, two = own.take(pa.array(p + at)), other.take(pa.array(q))
                    differ = pc.coalesce(pc.not_equal(one, two), pc.xor(one.is_null(), two.is_null())) if one.null_count or two.null_count else pc.not_equal(one, two)
                    one, two, v = (z.filter(differ) for z in (one, two, pa.array(s[p, q], pa.float64())))
                    if len(v):
                        yield pa.RecordBatch.from_arrays([one, two, v], ["key", "other", "strength"])
                        yield pa.RecordBatch.from_arrays([two, one, v], ["key", "other", "strength"])

    return in_arrow(pairs, meet, f"key {key}, other {key}, strength double")


class Cells:
    """Cells around vectors of a sample: in each table a vector's cell is told by its nearest centroid in each of the table's parts."""

    def __init__(self, tables: list[list[np.ndarray]]):
        self.tables = tables  # for each table the centroids of its parts

    def of(self, m: np.ndarray) -> np.ndarray:
        """The number of the cell of each row in each table; a number tells its table too."""
        out = np.empty((len(m), len(self.tables)), dtype=np.int64)
        for t, parts in enumerate(self.tables):
            code = np.zeros(len(m), dtype=np.int64)
            for centroids in parts:
                code = code * len(centroids) + (m @ centroids.T).argmax(axis=1)
            out[:, t] = code * len(self.tables) + t
        return out


def _moved(m: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors at just this cosine to the rows, in random directions."""
    off = rng.normal(size=m.shape)
    off -= (off * m).sum(axis=1, keepdims=True) * m
    length = np.linalg.norm(off, axis=1, keepdims=True)
    return cosine * m + math.sqrt(max(0.0, 1 - cosine * cosine)) * np.divide(off, length, out=np.zeros_like(off), where=length > 0)


def choose_cells(sample: np.ndarray, n: int, threshold: float, recall: float, size: int = CELL, seed: int = 11) -> Cells | None:
    """Cells for ``n`` vectors like the sample; about ``size`` of them to a cell. None where all pairs are less work.

    The number of cells grows with n, and tables are added until pairs at just the threshold, made from the sample, share a cell as
    often as ``recall`` wants. Closer pairs do so more often.
    """
    sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    cells = n / size
    if cells < 2 or len(sample) < 2:
        return None
    parts = []
    while cells > MOST_CENTROIDS:
        parts.append(MOST_CENTROIDS)
        cells /= MOST_CENTROIDS
    parts.append(max(2, round(cells)))
    rng = np.random.default_rng(seed)
    sample = rng.permutation(sample)
    probe, sample = np.split(sample, [min(PROBES, len(sample) // 4)])  # apart, as few of all vectors are near a centroid's origin
    near = _moved(probe, threshold, rng)
    met, tables = np.zeros(len(probe), dtype=bool), []
    while met.mean() < recall:
        # sample vectors, each moved far in a random direction: they follow the table's density, and no two tables share any
        tables.append([_moved(sample[rng.integers(len(sample), size=k)], 0.7, rng) for k in parts])
        one = Cells(tables[-1:])
        met |= (one.of(probe) == one.of(near))[:, 0]
        if len(tables) >= n / size / 2:
            return None
    return Cells(tables)


def in_cells(rows: DataFrame, cells: Cells, dim: int) -> DataFrame:
    """``rows`` (key, embedding, fresh) with ``cell``, once for each table, written; those of another dimension are left out."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            m, at = vectors(batch.column("embedding"), dim)
            code = sent.value.of(m)
            taken = batch.take(pa.array(np.repeat(at, code.shape[1])))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(code.ravel())], [*batch.schema.names, "cell"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return stash(rows.mapInArrow(run, f"{schema}, cell long"), "cells")


def similar_pairs_pruned(df: DataFrame, threshold: float = 0.85, recall: float = 0.95, size: int = CELL, block: int = BLOCK, dim: int | None = None, seed: int = 11, new: DataFrame | None = None) -> DataFrame:
    """``similar_pairs`` among vectors that share a cell only: it finds at least about ``recall`` of the pairs, in less than all pairs' work.

    The centroids are made from a sample of SAMPLE vectors at most; cells hold about ``size`` vectors however many there are, so twice the rows meet in twice the pairs a
    table of cells, and in a few more tables: the pairs met grow as about n ** 1.2 at a threshold of 0.85 in 64 dimensions.
    A cell of more than ``block`` vectors is dealt into blocks like the whole table in ``similar_pairs``, so that no task holds more than two blocks.
    With ``new``, only cells that hold some of these are looked at. Where all pairs are less work (few rows, or a low threshold), all are met.
    """
    dim = common_dimension(df if new is None else df.unionByName(new, True)) if dim is None else dim
    key = dict(df.dtypes)["key"]
    rows = _rows(df, new)
    picked = rows.filter(F.size("embedding") == F.lit(dim or 0)).orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(SAMPLE).select("embedding").toArrow()
    cells = choose_cells(vectors(picked["embedding"], dim or 0)[0], rows.count(), threshold, recall, size, seed)
    if cells is None:
        return similar_pairs(df, threshold, block, dim, new)
    own = in_cells(rows, cells, dim)
    sizes = own.groupBy("cell").agg(F.count("*").alias("n"), F.bool_or("fresh").alias("wanted")).filter("n > 1 AND wanted")
    sizes = stash(sizes.select("cell", F.ceil(F.col("n") / block).alias("blocks")), "sizes")
    dealt = own.join(small_side(sizes), "cell").withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")))
    dealt = dealt.withColumn("p", F.explode(_block_pairs("b", F.col("blocks")))).select("cell", "p.x", "p.y", "b", "fresh", "key", "embedding")
    found = dealt.groupBy("cell", "x", "y").applyInArrow(_meet(dim or 0, threshold), f"key {key}, other {key}, strength double")
    return found.groupBy("key", "other").agg(F.max("strength").alias("strength"))


def add_links(links: DataFrame, new: DataFrame, types: list[str] = LINK_TYPES, deduplicate: bool = True) -> DataFrame:
    """Links (from_id, to_id, link_type, strength, created_at) with the new ones of valid type that are not there yet."""
    ok = new.filter(F.col("link_type").isin(types))
    if deduplicate:
        key = ["from_id", "to_id", "link_type"]
        w = W.partitionBy(*key).orderBy("created_at", "strength")
        ok = ok.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n").join(links.select(*key), key, "left_anti")
    return links.unionByName(ok.select(*links.columns))


# --- topics ---------------------------------------------------------------------------------------


def match_topics(df: DataFrame, topics: DataFrame, threshold: float = 0.75, dim: int | None = None) -> DataFrame:
    """(key, topic_id, similarity): the nearest centroid (id, centroid; distinct ids) of each vector (key, embedding).

    The lowest id wins ties; below the threshold the topic is null. Only positive similarities count. Blocks of topics are paired with blocks of
    rows by a join. Vectors and centroids whose length is not ``dim`` (by default the commonest of ``df``) match nothing.
    """
    dim = common_dimension(df) if dim is None else dim
    kind = dict(df.dtypes)["key"]
    known = topics.filter(F.size("centroid") == F.lit(dim)).select(F.col("id").cast("long").alias("id"), "centroid")
    blocks = in_blocks(known, TOPIC_BLOCK, "id")
    packs = packed(df.select("key", "embedding"), PACK).withColumn("pack", F.monotonically_increasing_id())
    if blocks.count() > BROADCAST_BLOCKS:
        packs = stash(packs, "packs")  # its numbers must be the same for all blocks
    none = np.iinfo(np.int64).max

    def run(batches):
        last: tuple | None = None  # the pack, its keys, the best topics and similarities so far

        def done(pack, keys, t, s):
            place = np.arange(len(keys))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), pack)), pa.array(place), keys, pa.array(t, pa.int64(), mask=t == none), pa.array(s)], ["pack", "place", "key", "t", "s"])

        for batch in batches:
            for i in range(len(batch)):
                pack, keys = batch.column("pack")[i].as_py(), batch.column("key")[i].values
                if last is None or last[0] != pack:
                    if last is not None:
                        yield done(*last)
                    last = (pack, keys, np.full(len(keys), none), np.zeros(len(keys)))
                own = batch.column("rows")[i].values
                m, at = vectors(batch.column("embedding")[i].values, dim or 0)
                if len(at):
                    order = np.argsort(own.field("id").to_numpy())
                    ids, s = own.field("id").to_numpy()[order], np.round(m @ vectors(own.field("centroid"), dim)[0][order].T, 9)
                    j = s.argmax(axis=1)  # the first of equals: ids ascend
                    top, best, sim = s[np.arange(len(at)), j], last[2], last[3]
                    better = (top > sim[at]) | ((top == sim[at]) & (top > 0) & (ids[j] < best[at]))
                    best[at[better]], sim[at[better]] = ids[j[better]], top[better]
        if last is not None:
            yield done(*last)

    if not blocks.limit(1).count():
        return df.select("key", F.lit(None).cast("long").alias("topic_id"), F.lit(0.0).alias("similarity"))
    found = in_arrow(paired(packs, blocks, BROADCAST_BLOCKS).select("pack", "key", "embedding", "rows"), run, f"pack long, place long, key {kind}, t long, s double")
    if blocks.count() > 1:
        best = F.min_by(F.struct("key", "t", "s"), F.struct(-F.col("s"), F.col("t").isNull(), F.col("t")))
        found = found.groupBy("pack", "place").agg(best.alias("b")).select("b.*")
    return found.select("key", F.when(F.col("s") >= threshold, F.col("t")).alias("topic_id"), F.col("s").alias("similarity"))


def cluster_topics(df: DataFrame, threshold: float = 0.75, topics: DataFrame | None = None, recall: float | None = None) -> DataFrame:
    """(key, topic, name): rows (key, value, embedding), in key order, join the best existing topic or found one.

    A row joins the most similar among the given topics and the founders before it, if that similarity reaches the
    threshold. Whether a row founds a topic depends on smaller keys only: it does if no topic matches it and no
    smaller neighbour founds one. Rounds over the threshold graph decide all rows whose smaller neighbours are
    decided, until none is open. With ``recall`` the pairs of ``similar_pairs_pruned`` are used: less work, but a row may miss a topic.
    """
    dim = common_dimension(df)
    found = similar_pairs(df, threshold, dim=dim) if recall is None else similar_pairs_pruned(df, threshold, recall, dim=dim)
    pairs = stash(found.filter("other < key"), "pairs")
    matched = match_topics(df, topics, threshold, dim) if topics is not None else df.select("key", F.lit(None).cast("long").alias("topic_id"), F.lit(0.0).alias("similarity"))
    matched = stash(matched, "matched")
    state = stash(matched.select("key", F.when(F.col("topic_id").isNotNull(), False).alias("leads")), "state")
    while state.filter("leads IS NULL").limit(1).count():
        below = pairs.join(state.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.bool_or(F.coalesce("leads", F.lit(False))).alias("led"), F.bool_or(F.col("leads").isNull()).alias("open"))
        joined = state.join(below, "key", "left")
        led, open_ = F.coalesce("led", F.lit(False)), F.coalesce("open", F.lit(False))
        state = stash(joined.select("key", F.when(F.col("leads").isNotNull(), F.col("leads")).when(led, False).when(~open_, True).alias("leads")), "state")
    leaders = state.filter("leads").select(F.col("key").alias("other"))
    near = pairs.join(leaders, "other").groupBy("key").agg(F.max_by("other", F.struct(F.round("strength", 9))).alias("leader"), F.max(F.round("strength", 9)).alias("best"))
    ties = pairs.join(leaders, "other").join(near, "key").filter(F.round("strength", 9) == F.col("best")).groupBy("key").agg(F.min("other").alias("leader"), F.max("best").alias("best"))
    name = F.trim(F.regexp_replace(F.substring("value", 1, 50), "\n", " "))
    names = df.select(F.col("key").alias("leader"), F.when(name != "", name).otherwise(F.concat(F.lit("topic_"), "key")).alias("name"))
    out = matched.join(state, "key").join(ties, "key", "left")
    given = F.col("topic_id").isNotNull() & (F.col("similarity") >= F.coalesce("best", F.lit(-1.0)))
    topic = F.when(given, F.concat(F.lit("topic:"), F.col("topic_id").cast("string"))).when(F.col("leads"), F.col("key").cast("string")).otherwise(F.col("leader").cast("string"))
    founder = F.when(given, F.lit(None)).when(F.col("leads"), F.col("key")).otherwise(F.col("leader"))
    return out.select("key", topic.alias("topic"), founder.alias("leader")).join(names, "leader", "left").select("key", "topic", "name")


def topic_sums(members: DataFrame, vectors_: DataFrame) -> DataFrame:
    """(topic_id, total, n): the sums of the vectors of the distinct members (topic_id, key), which merge: see ``merge_sums``.

    Every task adds up its rows first and sends a vector a topic; the vectors of a topic then meet, one from each task. Vectors of another length than
    the commonest of the table are left out.
    """
    rows = members.select("topic_id", "key").distinct().join(vectors_.select("key", "embedding"), "key").select("topic_id", "embedding")
    dim, kind = common_dimension(vectors_) or 0, dict(members.dtypes)["topic_id"]

    def partial(batches):
        held: dict = {}
        for batch in batches:
            m, at = vectors(batch.column("embedding"), dim)
            topics = batch.column("topic_id").take(pa.array(at)).dictionary_encode()
            which = topics.indices.fill_null(len(topics.dictionary)).to_numpy(zero_copy_only=False)
            total, n = np.zeros((len(topics.dictionary) + 1, dim)), np.bincount(which, minlength=len(topics.dictionary) + 1)
            np.add.at(total, which, m)
            for name, t, c in zip([*topics.dictionary.to_pylist(), None], total, n.tolist(), strict=True):
                if c:
                    before = held.get(name)
                    held[name] = (t, c) if before is None else (before[0] + t, before[1] + c)
            if len(held) > TOPIC_BLOCK * 8:
                yield _sums(held, batch.schema.field("topic_id").type)
                held = {}
        if held:
            yield _sums(held, batch.schema.field("topic_id").type)

    return merge_sums(in_arrow(rows, partial, f"topic_id {kind}, total array<double>, n long"))


def _sums(held: dict, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held, kind), pa.array([t for t, _ in held.values()], pa.list_(pa.float64())), pa.array([n for _, n in held.values()], pa.int64())], ["topic_id", "total", "n"])


def merge_sums(*sums: DataFrame) -> DataFrame:
    """One row a topic of rows (topic_id, total, n): running sums and those of new members give the sums of all."""
    rows = sums[0]
    for more in sums[1:]:
        rows = rows.unionByName(more)
    schema = f"topic_id {dict(rows.dtypes)['topic_id']}, total array<double>, n long"

    def whole(batches):
        total, n, name = None, 0, None
        for batch in batches:
            for t, c in zip(batch.column("total").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total, n = np.array(t) if total is None else total + np.array(t), n + c
            name = batch.column("topic_id").slice(0, 1)
        yield pa.RecordBatch.from_arrays([name, pa.array([total], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["topic_id", "total", "n"])

    return rows.select("topic_id", "total", "n").groupBy("topic_id").applyInArrow(lambda t: pa.Table.from_batches(list(whole(t.to_batches()))), schema)


def centroids_of(sums: DataFrame, normalise: bool = False) -> DataFrame:
    """(topic_id, centroid): the mean of each topic's ``topic_sums``, or the unit vector in its direction."""
    whole = sums.select("topic_id", F.transform("total", lambda x: x / F.col("n")).alias("centroid"))
    if normalise:
        norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x))
        whole = whole.withColumn("centroid", F.when(norm > 0, F.transform("centroid", lambda x: x / norm)).otherwise(F.col("centroid")))
    return whole


def recalculate_centroids(members: DataFrame, vectors_: DataFrame, normalise: bool = False) -> DataFrame:
    """(topic_id, centroid): mean vector over the distinct members (topic_id, key)."""
    return centroids_of(topic_sums(members, vectors_), normalise)


def topic_sizes(members: DataFrame) -> DataFrame:
    return members.select("topic_id", "key").distinct().groupBy("topic_id").agg(F.count("*").alias("n"))


# --- confidence and decay -------------------------------------------------------------------------


def _composed(same: np.ndarray, low: np.ndarray, high: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix compositions of clamped additions x -> min(high, max(low, x + add)) within runs; ``same``: the place in the run.

    The composition of two is one again: first then second adds both, and clamps the first's bounds moved by the second.
    """
    low, high, add = low.copy(), high.copy(), add.copy()
    k = 1
    while (at := np.flatnonzero(same >= k)).size:
        before = at - k
        l2, h2, d2 = low[at], high[at], add[at]
        l1, h1, d1 = low[before], high[before], add[before]
        low[at], high[at], add[at] = np.clip(l1 + d2, l2, h2), np.clip(h1 + d2, l2, h2), d1 + d2
        k *= 2
    return low, high, add


def apply_confidence(memories: DataFrame, deltas: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """One log row per delta (key, at, delta, reason): step, old_confidence, new_confidence; applied in time order, clamped after each.

    The fold is no sum, but clamped additions compose: the deltas are range-partitioned by key and time, so that a key with
    many is split by time; every part composes its runs, and a run starts from what the earlier parts of its key
    compose to. Unknown keys are dropped.
    """
    order = ["key", "at", "delta", "reason"]
    kind = {n: t for n, t in deltas.dtypes if n in order}
    known = memories.select("key", F.coalesce("confidence", F.lit(0.5)).cast("double").alias("start"))
    rows = deltas.select(*order).filter("key IS NOT NULL AND delta IS NOT NULL")
    size, cores = rows.count(), deltas.sparkSession.sparkContext.defaultParallelism
    n = max(1, math.ceil(size / PART), min(cores, math.ceil(size / 10_000)))  # what a task holds is bounded, however many deltas there are
    parts = stash(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "deltas")
    run_schema = f"part int, key {kind['key']}, at {kind['at']}, delta double, reason {kind['reason']}, place long, low double, high double, add double, old_low double, old_high double, old_add double"

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        codes = table["key"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
        delta = table["delta"].to_numpy().astype(np.float64)
        after = _composed(place, np.full(len(codes), lo), np.full(len(codes), hi), delta)
        before = [np.where(place > 0, np.roll(x, 1), x0) for x, x0 in zip(after, (-np.inf, np.inf, 0.0), strict=True)]
        columns = [table["part"], *(table[c] for c in ("key", "at")), pa.array(delta), table["reason"], pa.array(place), *map(pa.array, [*after, *before])]
        return pa.table(columns, names=["part", "key", "at", "delta", "reason", "place", "low", "high", "add", "old_low", "old_high", "old_add"])

    runs = stash(parts.groupBy("part").applyInArrow(compose, run_schema), "runs")
    # what a key starts from in each of its parts: as many rows a key as parts hold it
    ends = runs.groupBy("part", "key").agg(F.max_by(F.struct("low", "high", "add"), "place").alias("f"), F.count("*").alias("n")).join(known, "key")
    earlier = F.array_sort(F.collect_list(F.struct("part", "f", "n")))
    clamp = lambda x, f: F.least(f["high"], F.greatest(f["low"], x + f["add"]))
    fold = F.aggregate("parts", F.struct(F.col("start").alias("v"), F.array().cast("array<double>").alias("out")), lambda s, x: F.struct(clamp(s["v"], x["f"]).alias("v"), F.array_append(s["out"], s["v"]).alias("out")))["out"]
    steps = F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("v"), F.array().cast("array<bigint>").alias("out")), lambda s, x: F.struct((s["v"] + x["n"]).alias("v"), F.array_append(s["out"], s["v"]).alias("out")))["out"]
    begun = ends.groupBy("key", "start").agg(earlier.alias("parts")).select("key", F.explode(F.arrays_zip(F.transform("parts", lambda x: x["part"]).alias("part"), fold.alias("from"), steps.alias("steps"))).alias("x")).select("key", "x.*")
    out = runs.join(begun, ["part", "key"])
    value = lambda a: F.least(F.col(f"{a}high"), F.greatest(F.col(f"{a}low"), F.col("from") + F.col(f"{a}add")))
    return out.select("key", (F.col("steps") + F.col("place") + 1).cast("int").alias("step"), value("old_").alias("old_confidence"), value("").alias("new_confidence"), "delta", "reason", "at")


def new_confidences(log: DataFrame) -> DataFrame:
    """(key, confidence) after the last step of a log."""
    return log.groupBy("key").agg(F.max_by("new_confidence", "step").alias("confidence"))


def short_postings(texts: DataFrame) -> DataFrame:
    """(key, phrase): each distinct run of one or two characters of each of ``texts`` (key, text)."""
    size = F.length("text")
    runs = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.substr("text", at, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return texts.select("key", F.explode(F.array_distinct(F.concat(runs(1), runs(2)))).alias("phrase"))


ACTION_DELTA = {"confirm": 0.05, "dismiss": -0.10}


def _short_hits(memories: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """(key, phrase) of written ``words`` (phrase) of one or two characters: at least the first ``most`` memories (key, text) of each, by key.

    A word that the FIRST memories hold often enough is not looked for in the others.
    """
    last = memories.select("key").orderBy("key").limit(FIRST).agg(F.max("key")).first()[0]
    if last is None:
        return short_postings(memories).join(small_side(words), "phrase")
    near = stash(short_postings(memories.filter(F.col("key").isNull() | (F.col("key") <= F.lit(last)))).join(small_side(words), "phrase").select("key", "phrase"), "near")
    full = near.groupBy("phrase").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("phrase")
    rest = stash(words.join(full, "phrase", "left_anti"), "rest")
    if not rest.limit(1).count():
        return near
    far = memories.filter(F.col("key") > F.lit(last))
    return near.unionByName(short_postings(far).join(small_side(rest), "phrase").select("key", "phrase"))


def words_of_memories(feedback: DataFrame, memories: DataFrame, most: int = 50, index: DataFrame | None = None) -> DataFrame:
    """(key, word): by key the first ``most`` memories whose value contains a feedback's word. See ``deltas_from_feedback``."""
    words = stash(feedback.select("word", F.lower("word").alias("phrase")).filter("word != ''").distinct(), "words")
    value = F.lower(F.coalesce("value", F.lit("")))
    if not words.filter(F.length("phrase") > 2).limit(1).count():
        index = None
    elif index is None:
        index = build_index(memories.select("key", "value"), ("value",))
    short = stash(words.filter(F.length("phrase") < 3).select("phrase").distinct(), "short")
    hits = _short_hits(memories.select("key", value.alias("text")), short, most) if short.limit(1).count() else None
    if index is not None:
        long = occurrences_of(index, phrase_blocks(words)).select("key", "phrase")
        hits = long if hits is None else hits.unionByName(long)
    hits = memories.select("key", value.alias("phrase")).limit(0) if hits is None else hits
    hits = hits.join(words, "phrase").select("key", "word")
    return hits.withColumn("n", F.row_number().over(W.partitionBy("word").orderBy("key"))).filter(F.col("n") <= most).drop("n")


def _action_delta() -> Column:
    return F.when(F.col("action") == "confirm", ACTION_DELTA["confirm"]).when(F.col("action") == "dismiss", ACTION_DELTA["dismiss"]).otherwise(-0.05)


def deltas_from_feedback(feedback: DataFrame, memories: DataFrame, most: int = 50, index: DataFrame | None = None) -> DataFrame:
    """(key, at, delta, reason) for each memory whose value contains a feedback's word, by key the first ``most`` per word.

    feedback: word, action, at. Each distinct word is looked for once, case-insensitively: by trigram postings of the values, or, if it
    has fewer than three characters, by postings of one and two characters. ``index`` is a full-text index of the values alone, else one is made if needed.
    """
    first = words_of_memories(feedback, memories, most, index)
    return feedback.join(first, "word").select("key", "at", _action_delta().alias("delta"), F.concat_ws(":", F.lit("feedback"), "action", "word").alias("reason"))


def _whole(add: np.ndarray, lo: float, hi: float) -> tuple[float, float, float]:
    """(low, high, add) that clamped additions, one after the other, come to: neighbours are composed until one is left."""
    low, high = np.full(len(add), lo), np.full(len(add), hi)
    while len(add) > 1:
        n = len(add) // 2 * 2
        l2, h2, d2 = low[1:n:2], high[1:n:2], add[1:n:2]
        both = np.clip(low[0:n:2] + d2, l2, h2), np.clip(high[0:n:2] + d2, l2, h2), add[0:n:2] + d2
        low, high, add = (np.append(x, y[n:]) for x, y in zip(both, (low, high, add), strict=True))
    return float(low[0]), float(high[0]), float(add[0])


def feedback_functions(feedback: DataFrame, memories: DataFrame, most: int = 50, index: DataFrame | None = None, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(key, low, high, add): what the deltas of ``deltas_from_feedback`` do to a memory's confidence c, all in all: min(high, max(low, c + add)).

    The same as the last step of ``apply_confidence``, without its log and without a row for each feedback and memory: feedback is dealt by time, and a task composes
    the deltas of each memory that it knows. Of feedback of the same time and delta the order does not matter. With more than KNOWN memories of words the deltas are dealt by key and time.
    """
    first = stash(words_of_memories(feedback, memories, most, index).filter("key IS NOT NULL"), "first")
    kind, by_time = dict(memories.dtypes)["key"], first.count() <= KNOWN
    if by_time:
        known = first.toArrow().combine_chunks()
        names = known["word"].combine_chunks().unique()
        of_key: dict = {}
        for key, w in zip(known["key"].to_pylist(), pc.index_in(known["word"], value_set=names).to_pylist(), strict=True):
            of_key.setdefault(key, set()).add(w)
        classes: dict[tuple, list] = {}
        for key, w in of_key.items():  # memories of the same words have the same deltas
            classes.setdefault(tuple(sorted(w)), []).append(key)
        coded = feedback.sparkSession.createDataFrame(list(enumerate(names.to_pylist())), "w int, word string")
        rows, order = feedback.join(F.broadcast(coded), "word").select("w", "at", _action_delta().alias("delta")), ["at", "delta", "w"]
    else:
        rows, order = feedback.join(first, "word").select("key", "at", _action_delta().alias("delta")), ["key", "at", "delta"]
    size, cores = rows.count(), feedback.sparkSession.sparkContext.defaultParallelism
    n = max(1, math.ceil(size / PART), min(cores, math.ceil(size / 10_000)))

    def run(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in order], null_placement="at_end")).combine_chunks()
        delta, out = table["delta"].to_numpy(), []
        if by_time:
            w = table["w"].to_numpy()
            places = np.argsort(w, kind="stable")
            edges = np.searchsorted(w[places], np.arange(len(names) + 1))
            for of, keys in classes.items():
                at = np.sort(np.concatenate([places[edges[x] : edges[x + 1]] for x in of]))
                if len(at):
                    f = _whole(delta[at], lo, hi)
                    out += [(k, *f) for k in keys]
        else:
            codes = table["key"].combine_chunks().dictionary_encode()
            which = codes.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(which, prepend=-1))
            out = [(codes.dictionary[int(which[a])].as_py(), *_whole(delta[a:b], lo, hi)) for a, b in zip(starts, np.append(starts[1:], len(which)), strict=True)]
        part = table["part"][0].as_py()
        kinds = [table.schema.field("key").type if not by_time else known.schema.field("key").type, *[pa.float64()] * 3]
        columns = [pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int32()), *columns], ["part", "key", "low", "high", "add"])

    dealt = rows.repartitionByRange(n, *[F.col(c).asc_nulls_last() for c in order]).withColumn("part", F.spark_partition_id())
    parts = stash(in_arrow(dealt, run, f"part int, key {kind}, low double, high double, add double"), "functions")
    # a key has as many rows as parts hold it
    clip = lambda v, f: F.least(f["high"], F.greatest(f["low"], v + f["add"]))
    then = lambda s, f: F.struct(clip(s["low"], f).alias("low"), clip(s["high"], f).alias("high"), (s["add"] + f["add"]).alias("add"))
    nothing = F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0.0).alias("add"))
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "low", "high", "add"))), nothing, then)
    return parts.groupBy("key").agg(whole.alias("f")).select("key", "f.*")


def after_functions(memories: DataFrame, functions: DataFrame) -> DataFrame:
    """``memories`` with the confidences to which ``feedback_functions`` take theirs; one without a function keeps its own."""
    new = F.least("high", F.greatest("low", F.coalesce("confidence", F.lit(0.5)) + F.col("add")))
    out = memories.join(functions, "key", "left").withColumn("confidence", F.when(F.col("add").isNull(), F.col("confidence")).otherwise(new))
    return out.select(*memories.columns)


def reinforce(df: DataFrame, recalls: DataFrame) -> DataFrame:
    """Stability times 1.1 for each recall (key, at), the last review at the latest; a missing stability starts from the base."""
    r = recalls.groupBy("key").agg(F.count("*").alias("n"), F.max("at").alias("latest"))
    start = F.coalesce("stability", base_stability(F.col("source"), F.col("importance")))
    out = df.join(r, "key", "left")
    return out.withColumns({"stability": start * F.pow(F.lit(1.1), F.coalesce("n", F.lit(0))), "last_review": F.coalesce("latest", "last_review")}).select(*df.columns)


def archive_stale(df: DataFrame, now: float, max_age_days: int = 30, min_conf: float = 0.2) -> DataFrame:
    """Adds ``newly_archived`` and sets importance to archived where the confidence is low and the last update old."""
    stale = F.coalesce((F.col("confidence") < min_conf) & (F.col("updated_at") < now - max_age_days * 86400), F.lit(False))
    fresh = stale & (F.coalesce("importance", F.lit("")) != "archived")
    return df.withColumn("newly_archived", fresh).withColumn("importance", F.when(stale, "archived").otherwise(F.col("importance")))


# --- reports --------------------------------------------------------------------------------------


def contradiction_report(links: DataFrame, memories: DataFrame, limit: int = 20) -> DataFrame:
    """The newest contradictions with both values."""
    top = links.filter("link_type = 'contradicts'").orderBy(F.desc("created_at"), "from_id", "to_id").limit(limit)
    side = lambda k: memories.select(F.col("key").alias(f"{k}_id"), F.col("value").alias(f"{k}_value"))
    out = top.join(side("from"), "from_id", "left").join(side("to"), "to_id", "left")
    return out.select("from_id", "to_id", "strength", F.coalesce("from_value", F.lit("")).alias("from_value"), F.coalesce("to_value", F.lit("")).alias("to_value"))


def health_report(memories: DataFrame, links: DataFrame, now: float) -> DataFrame:
    """One row of counts over memories and links."""
    old = (F.col("confidence") < 0.2) & (F.col("updated_at") < now - 30 * 86400)
    m = memories.agg(
        F.count("*").alias("total_memories"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("avg_confidence"), F.count_if(old).alias("gc_candidates"), F.count_if(F.col("importance") == "archived").alias("archived"), F.lit(1).alias("one")
    )
    n = links.agg(F.count_if(F.col("link_type") == "contradicts").alias("contradictions"), F.count("*").alias("links"), F.lit(1).alias("one"))
    return m.join(n, "one").drop("one")


def memory_stats(memories: DataFrame) -> DataFrame:
    """(what, label, n): rows by source and by importance, and oldest and newest times, in one pass."""
    label = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "(empty)").otherwise(F.col(c))
    keyed = memories.select(
        F.explode(F.array(F.struct(F.lit("source").alias("what"), label("source").alias("label")), F.struct(F.lit("importance").alias("what"), label("importance").alias("label")), F.struct(F.lit("total").alias("what"), F.lit("").alias("label")))).alias("x"),
        "created_at", "updated_at",
    )
    return keyed.groupBy("x.what", "x.label").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"), F.max("updated_at").alias("newest"))


def upsert_profile(attrs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per (profile_id, attr_key): the newest value and source, the greatest confidence; the category stays that of the first row."""
    both = attrs.unionByName(incoming)
    pick = lambda c, f=F.max_by: f(c, F.struct("updated_at", c)).alias(c)
    return both.groupBy("profile_id", "attr_key").agg(
        pick("attr_value"), pick("category", F.min_by), F.max("confidence").alias("confidence"), pick("source"), F.max("updated_at").alias("updated_at")
    )


def profile_summary(attrs: DataFrame) -> DataFrame:
    """(profile_id, summary): attributes under their category in a fixed order, most confident first; a confidence below 0.8 is shown."""
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    shown = F.when(F.col("confidence") < 0.8, F.concat(F.lit(" ("), F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%)"))).otherwise(F.lit(""))
    line = F.concat(F.lit("- "), "attr_key", F.lit(": "), "attr_value", shown)
    known = attrs.filter(place > 0)
    per = known.groupBy("profile_id", place.alias("p"), "category").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "attr_key", line.alias("line")))).alias("x"))
    block = F.concat_ws("\n", F.concat(F.lit("### "), "category"), F.array_join(F.transform("x", lambda y: y["line"]), "\n"))
    whole = per.groupBy("profile_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", block.alias("b")))), lambda y: y["b"]), "\n").alias("summary"))
    return attrs.select("profile_id").distinct().join(whole, "profile_id", "left").select("profile_id", F.coalesce("summary", F.lit("(no profile data)")).alias("summary"))


def latest(df: DataFrame, n: int = 100, source: str | None = None) -> DataFrame:
    """The newest n rows, of one source if given."""
    rows = df.filter(F.col("source") == source) if source is not None else df
    return rows.orderBy(F.desc("updated_at"), "key").limit(n)


def page(reviews: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the history, newest first, with a 100-character preview and the total."""
    total = reviews.agg(F.count("*").alias("total"))
    rows = reviews.orderBy(F.desc("created_at"), "review_id").offset(offset).limit(limit)
    return rows.select("review_id", F.substring("text", 1, 100).alias("preview"), "status", "overall_risk", "violation_count").join(F.broadcast(total))
