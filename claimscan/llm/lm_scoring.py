"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions. A node of the context tree is a context, the last 0 to DEPTH bytes;
for each of the 255 places a decision can have in a byte it counts zeros and ones, estimates them by
Krichevsky and Trofimov, and mixes its own estimate half and half with the product of its children's
mixtures (Willems, Shtarkov and Tjalkens 1995). The weights that all the training text gives to
"stop here" and "look further back" are kept, so that a byte's probability is the mixture over all depths
on its context's path. A text ends with a byte that UTF-8 never uses, so that the probabilities of all
texts add up to one. The code length per byte follows from the score.

Counting and mixing: every context that occurs has its node, so the tree grows with the text and is never in one
place. The documents are dealt into parts of about PART bytes, each with its distinct byte strings of DEPTH + 1 and
how often those that are learned from occur. The strings are dealt by the last NEAR bytes of their context into
buckets; a bucket has whole subtrees, mixes them, and hands up one sum for each node above. The tree of contexts of
less than NEAR bytes, which no text can make larger than 1 + 256 + 65,536 nodes, is mixed on the driver and sent to the
tasks. Each bucket then has the log probabilities of all its strings; a part asks it once for its own, and
the answers are joined to the part. A bucket that many parts ask meets them in groups of about GROUP bytes.
Strings, counts and answers travel packed.

Beside it, a unigram base score over words: the words' counts are a table joined by a shuffle, all but
the most frequent words of up to HEAD_BYTES bytes, up to HEAD_WORDS, which have bounded size and are sent to the
tasks instead; so no frequent word meets in one task.

Cases: a null text counts as empty, and has the end only; rows without doc_id are scored, but not learned
from; repeated rows count as often as they occur and are scored each; with nothing to learn from, all
decisions are even and no word is known; an empty table gives an empty result. Further columns are
ignored, also such that bear the name of a result column.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import NOT_SPACE, buffers, chunks, codes, mix, split_words
from ._work import in_arrow, most_frequent, stash, table

DEPTH = 5
#: The byte that ends a text and, as context, stands before it.
END = 0xFF
HEAD_WORDS, HEAD_BYTES = 131_072, 64
SMOOTHING = 0.1
CHUNK = 4 << 20
#: Bytes of text whose byte strings are made at a time; a string takes eight times as much in each array.
GRAM_CHUNK = 1 << 20
#: Places of a decision whose trees are mixed at a time; bounds the driver's arrays.
PLACES = 16
#: Subtrees of contexts of so many bytes stay together.
NEAR = 3
#: Bytes of text of a part of the documents, and for each bucket of the tree; how many buckets at least and at most.
PART, BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 8 << 20, 16 << 20, 64, 4096
#: Packed bytes of a bucket that meet in one task.
GROUP = 64 << 20

PARTS = "part long, body binary, grams array<binary>, counts array<binary>"
COUNTS = "bucket int, grams binary, n binary"
SUBTREES = COUNTS + ", kind array<int>, key array<long>, x array<double>"
SCORED = "doc_id long, n_tokens long, head_known long, head_sum double, score double, bits_per_byte double, words array<string>, counts array<int>"


# --- packing ----------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """The bytes of numbers of one type, by place and compressed; ascending whole numbers as differences."""
    if not len(values):
        return b""
    if values.dtype == np.int64:
        values = np.diff(values, prepend=0)
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(packed: bytes, kind: type) -> np.ndarray:
    if not packed:
        return np.zeros(0, dtype=kind)
    n, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed[8:], n * width, codec="zstd"), dtype=np.uint8)
    values = np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()
    return np.cumsum(values) if kind == np.int64 else values


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


# --- counting -------------------------------------------------------------------------------------


def framed(batch: pa.RecordBatch, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, each text after ``depth`` END bytes and before one; the indexes of the bytes to
    predict, ends included; and where those of each text begin."""
    data, offsets = buffers(batch.column("text"))
    n = len(batch)
    out = np.full(len(data) + n * (depth + 1), END, dtype=np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * depth + np.arange(n), np.diff(offsets))
    out[at] = data
    predicted = np.ones(len(out), dtype=bool)
    begin = offsets[:-1] + np.arange(n) * (depth + 1)
    for k in range(depth):
        predicted[begin + k] = False
    return out, np.flatnonzero(predicted), offsets + np.arange(n + 1)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all words of ``docs``; the end of a text counts as the empty word."""

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK):
                index, distinct = codes(split_words(*buffers(batch.column("text")), NOT_SPACE).words)
                n = np.bincount(index, minlength=len(distinct))
                words = pa.concat_arrays([distinct.cast(pa.binary()).cast(pa.string()), pa.array([""])])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n, len(batch)))], ["word", "c"])

    return in_arrow(docs.select("text"), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def distinct_grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings of DEPTH + 1 bytes as numbers, the latest byte lowest; the index of each byte's string; each text's first."""
    data, at, first = framed(batch)
    gram = np.zeros(len(at), dtype=np.int64)
    for k in range(DEPTH, -1, -1):
        gram = (gram << 8) | data[at - k]
    index, distinct = codes(pa.array(gram))
    return distinct.to_numpy(), index, first


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(((grams >> 8) & ((1 << 8 * NEAR) - 1)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _cut(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of ascending ``grams`` by bucket, and where each bucket begins in it."""
    b = bucket_of(grams, buckets)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def deal(rows: DataFrame, buckets: int) -> DataFrame:
    """PARTS of rows (doc_id, text, asked, learned): the asked documents, the distinct byte strings by bucket, and how often the learned have them."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        grams: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def part():
            keys, index = np.unique(np.concatenate(grams), return_inverse=True)
            n = np.bincount(index, weights=np.concatenate(counts), minlength=len(keys)).astype(np.uint64)
            order, cuts = _cut(keys, buckets)
            cells = lambda x: pa.array([[pack(x[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]], pa.list_(pa.binary()))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in held:
                    out.write_batch(batch)
            body = sink.getvalue().to_pybytes() if any(len(b) for b in held) else None
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([body], pa.binary()), cells(keys), cells(n)], _names(PARTS))

        for whole in batches:
            for batch in chunks(whole, "text", GRAM_CHUNK):
                own, index, first = distinct_grams(batch)
                learned = batch.column("learned").to_numpy(zero_copy_only=False).astype(np.float64)
                grams.append(own)
                counts.append(np.bincount(index, weights=np.repeat(learned, np.diff(first)), minlength=len(own)))
                held.append(batch.select(["doc_id", "text"]).filter(batch.column("asked")))
                size += len(index)
                if size >= PART:
                    yield part()
                    held, grams, counts, size, number = [], [], [], 0, number + 1
                    pa.default_memory_pool().release_unused()
        if held:
            yield part()

    return in_arrow(rows, run, PARTS)


# --- the tree ---------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    back = np.zeros_like(x)
    for k in range(8):
        back += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - back


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


@cache
def _gammas(size: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(size, dtype=np.float64)
    return log_gamma(k + 0.5), log_gamma(k + 1.0)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``log_kt`` of whole numbers, most of which are small."""
    half, one = _gammas()
    large = a + b >= len(one)
    i, j = np.where(large, 0, a).astype(np.int64), np.where(large, 0, b).astype(np.int64)
    out = half[i] + half[j] - one[i + j] - np.log(np.pi)
    if large.any():
        out[large] = log_kt(a[large], b[large])
    return out


class Subtrees:
    """Nodes of NEAR to DEPTH bytes of context over ascending distinct byte strings, seen ``n`` times (0: only asked for)."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.keys, self.n, self.up = {DEPTH: grams}, {DEPTH: n.astype(np.float64)}, {}
        for d in range(DEPTH - 1, NEAR - 1, -1):  # (context of d bytes, next byte), ascending
            self.keys[d], self.up[d + 1] = np.unique(self.keys[d + 1] & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
            self.n[d] = np.bincount(self.up[d + 1], weights=self.n[d + 1], minlength=len(self.keys[d]))

    def mixed(self, bit: int):
        """Of one place in the byte, by depth: each key's node and place as a number, the first key of each, its
        parent, zeros and ones, log estimate and log mixture."""
        of, first, parent, own, log_e, log_w = {}, {}, {}, {}, {}, {}
        for d in range(NEAR, DEPTH + 1):
            change = np.diff(self.keys[d] >> (8 - bit), prepend=-1) != 0
            of[d], first[d] = np.cumsum(change) - 1, np.flatnonzero(change)
            is_one = (self.keys[d] >> (7 - bit)) & 1
            ones = np.add.reduceat(self.n[d] * is_one, first[d])
            own[d] = np.add.reduceat(self.n[d], first[d]) - ones, ones
            log_e[d] = _log_kt(*own[d])
            if d > NEAR:
                parent[d] = of[d - 1][self.up[d][first[d]]]
        log_w[DEPTH] = log_e[DEPTH]
        for d in range(DEPTH - 1, NEAR - 1, -1):
            below = np.bincount(parent[d + 1], weights=log_w[d + 1], minlength=len(first[d]))
            log_w[d] = np.logaddexp(log_e[d], below) + np.log(0.5)
        return of, first, parent, own, log_e, log_w

    def above(self) -> tuple[np.ndarray, np.ndarray]:
        """(node of NEAR - 1 bytes and place, log product of its children's mixtures here)."""
        keys, sums = [], []
        for bit in range(8):
            _, first, _, _, _, log_w = self.mixed(bit)
            k = self.keys[NEAR][first[NEAR]]
            place = (1 << bit) | ((k & 0xFF) >> (8 - bit))
            node = (k >> 8) & ((1 << 8 * (NEAR - 1)) - 1)
            key, index = np.unique((node << 8) | place, return_inverse=True)
            keys.append(key)
            sums.append(np.bincount(index, weights=log_w[NEAR], minlength=len(key)))
        return np.concatenate(keys), np.concatenate(sums)

    def log_probabilities(self, top: Top) -> np.ndarray:
        """log10 probability of the last byte of each string after the others."""
        total = np.zeros(len(self.keys[DEPTH]))
        for bit in range(8):
            of, first, parent, own, log_e, log_w = self.mixed(bit)
            k = self.keys[NEAR][first[NEAR]]
            one, zero, further = top.at(k >> 8, (1 << bit) | ((k & 0xFF) >> (8 - bit)))
            for d in range(NEAR, DEPTH + 1):
                if d > NEAR:
                    one, zero, further = one[parent[d]], zero[parent[d]], further[parent[d]]
                stop = np.exp(np.minimum(log_e[d] + np.log(0.5) - log_w[d], 0)) if d < DEPTH else 1.0
                p = (own[d][1] + 0.5) / (own[d][0] + own[d][1] + 1)
                one, zero, further = one + further * stop * p, zero + further * stop * (1 - p), further * (1 - stop)
            is_one = (self.keys[DEPTH] >> (7 - bit)) & 1
            total += np.log10(np.where(is_one, one[of[DEPTH]], zero[of[DEPTH]]))
        return total


class Top:
    """Nodes of less than NEAR bytes. ``state[node, place]``: what the mixture down to the node, itself included, gives to
    one and to zero, and the weight that is left for longer contexts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, below_keys: np.ndarray, below: np.ndarray):
        last = NEAR - 1
        nodes = {last: np.unique(keys >> 8)}
        tables = {last: np.zeros((len(nodes[last]), 256))}
        tables[last][np.searchsorted(nodes[last], keys >> 8), keys & 0xFF] = n
        up = {}
        for d in range(last - 1, -1, -1):
            nodes[d], up[d + 1] = np.unique(nodes[d + 1] & ((1 << 8 * d) - 1), return_inverse=True)
            if d == 0 and not len(nodes[0]):
                nodes[0] = np.zeros(1, np.int64)
            tables[d] = np.zeros((len(nodes[d]), 256))
            np.add.at(tables[d], up[d + 1], tables[d + 1])
        given = np.zeros((len(nodes[last]), 256))
        given[np.searchsorted(nodes[last], below_keys >> 8), below_keys & 0xFF] = below
        self.nodes = nodes
        self.state = {d: np.zeros((len(nodes[d]), 256, 3), dtype=np.float32) for d in nodes}
        for bit in range(8):
            width = 128 >> bit
            for lo in range(0, 1 << bit, PLACES):
                hi = min(lo + PLACES, 1 << bit)
                at = slice((1 << bit) + lo, (1 << bit) + hi)
                own = {d: t[:, lo * 2 * width : hi * 2 * width].reshape(len(t), hi - lo, 2, width).sum(axis=3) for d, t in tables.items()}
                log_e = {d: log_kt(x[:, :, 0], x[:, :, 1]) for d, x in own.items()}
                sums, log_w = given[:, at], {}
                for d in range(last, -1, -1):
                    log_w[d] = np.logaddexp(log_e[d], sums) + np.log(0.5)
                    if d:
                        sums = np.zeros((len(nodes[d - 1]), hi - lo))
                        np.add.at(sums, up[d], log_w[d])
                one, zero, further = np.zeros((1, hi - lo)), np.zeros((1, hi - lo)), np.ones((1, hi - lo))
                for d in range(last + 1):
                    if d:
                        one, zero, further = one[up[d]], zero[up[d]], further[up[d]]
                    stop = np.exp(np.minimum(log_e[d] + np.log(0.5) - log_w[d], 0))
                    p = (own[d][:, :, 1] + 0.5) / (own[d].sum(axis=2) + 1)
                    one, zero, further = one + further * stop * p, zero + further * stop * (1 - p), further * (1 - stop)
                    self.state[d][:, at] = np.stack([one, zero, further], axis=2)

    def at(self, context: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The state of the longest node there is for each context (only its last bytes count)."""
        out = self.state[0][np.zeros(len(place), np.int64), place]
        for d in range(1, NEAR):
            if len(self.nodes[d]):
                own = context & ((1 << 8 * d) - 1)
                i = np.minimum(np.searchsorted(self.nodes[d], own), len(self.nodes[d]) - 1)
                out = np.where((self.nodes[d][i] == own)[:, None], self.state[d][i, place], out)
        return tuple(out.astype(np.float64).T)


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings of rows of COUNTS, ascending, and their sums."""
    grams, index = np.unique(np.concatenate([unpack(x, np.int64) for x in table["grams"].to_pylist()]), return_inverse=True)
    n = np.concatenate([unpack(x, np.uint64) for x in table["n"].to_pylist()])
    return grams, np.bincount(index, weights=n, minlength=len(grams)).astype(np.uint64)


def _cell(value, kind: pa.DataType) -> pa.Array:
    return pa.array([value], kind)


def merge_counts(counted: DataFrame) -> DataFrame:
    """COUNTS with so few rows a bucket that a task can hold those of any: else they are first added up in groups."""

    def add(table: pa.Table) -> pa.Table:
        grams, n = _merge(table)
        return pa.table([table["bucket"].slice(0, 1), _cell(pack(grams), pa.binary()), _cell(pack(n), pa.binary())], names=_names(COUNTS))

    while True:
        size, rows = F.sum(F.octet_length("grams") + F.octet_length("n")), F.count("*")
        groups = counted.groupBy("bucket").agg(F.least(F.ceil(size / GROUP), F.ceil(rows / 4)).alias("g")).agg(F.max("g")).first()[0] or 1
        if groups <= 1:
            return counted
        group = F.pmod(F.xxhash64("grams", "n"), F.lit(groups)).alias("group")
        counted = stash(counted.groupBy("bucket", group).applyInArrow(add, COUNTS), "counts")


def fit(parts: DataFrame) -> DataFrame:
    """(bucket, grams, logp): the log10 probabilities of all byte strings of written ``parts``, learned from all their counts."""

    def gather(table: pa.Table) -> pa.Table:
        grams, n = _merge(table)
        key, x = Subtrees(grams, n).above()
        near, index = np.unique(grams & ((1 << 8 * NEAR) - 1), return_inverse=True)  # NEAR - 1 bytes of context and the next
        kind = np.repeat([0, 1], [len(near), len(key)])
        columns = [np.concatenate([near, key]), np.concatenate([np.bincount(index, weights=n), x])]
        cells = [_cell(pack(grams), pa.binary()), _cell(pack(n), pa.binary()), _cell(kind, pa.list_(pa.int32())), _cell(columns[0], pa.list_(pa.int64())), _cell(columns[1], pa.list_(pa.float64()))]
        return pa.table([table["bucket"].slice(0, 1), *cells], names=_names(SUBTREES))

    counted = parts.select(F.posexplode(F.arrays_zip("grams", "counts")).alias("bucket", "x")).select("bucket", "x.grams", F.col("x.counts").alias("n")).filter(F.octet_length("grams") > 0)
    tree = stash(merge_counts(counted).groupBy("bucket").applyInArrow(gather, SUBTREES), "subtrees")
    up = tree.select(F.explode(F.arrays_zip("kind", "key", "x")).alias("r")).groupBy("r.kind", "r.key").agg(F.sum("r.x").alias("x")).toArrow()  # at most 2 * 2^24
    kind, key, x = (up[c].to_numpy() for c in ("kind", "key", "x"))
    top = parts.sparkSession.sparkContext.broadcast(Top(key[kind == 0], x[kind == 0], key[kind == 1], x[kind == 1]))

    def run(batches):
        for batch in batches:
            for bucket, packed, n in zip(*(batch.column(c) for c in ("bucket", "grams", "n")), strict=True):
                logp = Subtrees(unpack(packed.as_py(), np.int64), unpack(n.as_py(), np.uint64)).log_probabilities(top.value)
                yield pa.RecordBatch.from_arrays([_cell(bucket.as_py(), pa.int32()), _cell(packed.as_py(), pa.binary()), _cell(pack(logp.astype(np.float32)), pa.binary())], ["bucket", "grams", "logp"])

    return stash(in_arrow(tree.select("bucket", "grams", "n"), run, "bucket int, grams binary, logp binary"), "model")


def answer(parts: DataFrame, model: DataFrame) -> DataFrame:
    """(part, bucket, logp): the packed log probabilities of what each part asks a bucket."""
    asks = parts.filter("body IS NOT NULL").select("part", F.posexplode("grams").alias("bucket", "asked")).filter(F.octet_length("asked") > 0)
    groups = asks.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("asked")) / GROUP).alias("groups"))
    groups = F.broadcast(stash(groups, "groups"))  # at most MOST_BUCKETS rows
    asks = asks.join(groups, "bucket").select("part", "bucket", "asked", F.pmod(F.xxhash64("part"), F.col("groups")).alias("group"))
    known = model.join(groups, "bucket").select("bucket", "grams", "logp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(theirs):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["part", "bucket", "logp"])
        grams, logp = unpack(ours["grams"][0].as_py(), np.int64), unpack(ours["logp"][0].as_py(), np.float32)
        out = [pack(logp[np.searchsorted(grams, unpack(x.as_py(), np.int64))]) for x in theirs["asked"]]
        return pa.table([theirs["part"], theirs["bucket"], pa.array(out, pa.binary())], names=["part", "bucket", "logp"])

    return known.groupBy("bucket", "group").cogroup(asks.groupBy("bucket", "group")).applyInArrow(run, "part long, bucket int, logp binary")


# --- scoring ----------------------------------------------------------------------------------------


def score(docs: DataFrame, train: DataFrame | Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of ``docs``.

    Learns from the rows of the table ``train``, or from those of ``docs`` for which the condition ``train`` holds.
    """
    spark = docs.sparkSession
    row = lambda df, asked, learned: df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(asked).alias("asked"), F.coalesce(learned, F.lit(False)).alias("learned"))
    if isinstance(train, DataFrame):
        rows = row(docs, True, F.lit(False)).union(row(train, False, F.lit(True)))
    else:
        rows, train = row(docs, True, train), docs.filter(train)
    words = stash(count_words(train), "words")
    n_train, n_distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = most_frequent(words.filter(F.octet_length("word") <= HEAD_BYTES), "c", HEAD_WORDS).toArrow()
    known, often = head["word"].combine_chunks().cast(pa.large_binary()), np.append(head["c"].to_numpy(), 0)
    ends = int((np.array(words.filter("word = ''").select("c").collect(), dtype=np.int64)).sum())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = stash(deal(rows, min(MOST_BUCKETS, max(LEAST_BUCKETS, size // BUCKET))), "parts")
    sent = spark.sparkContext.broadcast((known, often))
    def one(batch: pa.RecordBatch, grams: np.ndarray, logp: np.ndarray, known: pa.Array, often: np.ndarray) -> pa.RecordBatch:
        own, which, starts = distinct_grams(batch)
        each = logp[np.searchsorted(grams, own)].astype(np.float64)[which]
        found = split_words(*buffers(batch.column("text")), NOT_SPACE)
        index, distinct = codes(found.words)
        place = pc.index_in(distinct, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
        place = place[index] if len(index) else np.zeros(0, np.int64)
        total = np.concatenate([[0.0], np.cumsum(np.where(place >= 0, np.log10(often[place] + SMOOTHING), 0.0))])
        in_head = np.concatenate([[0], np.cumsum(place >= 0)])
        tail = np.flatnonzero(place < 0)
        size = max(1, len(distinct))
        doc = np.searchsorted(found.first, tail, "right") - 1
        pair, n = np.unique(doc * size + index[tail], return_counts=True)
        edges = np.searchsorted(pair, np.arange(len(batch) + 1) * size)
        a, b = found.first[:-1], found.first[1:]
        total_score = np.add.reduceat(each, starts[:-1])
        offsets = pa.array(edges.astype(np.int32))
        texts = distinct.cast(pa.binary()).cast(pa.string()).take(pa.array(pair % size))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(b - a + 1),
                pa.array(in_head[b] - in_head[a]),
                pa.array(total[b] - total[a]),
                pa.array(total_score),
                pa.array(total_score / (-np.log10(2.0) * np.diff(starts))),
                pa.ListArray.from_arrays(offsets, texts),
                pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))),
            ],
            _names(SCORED),
        )

    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        known, often = sent.value
        grams = np.concatenate([unpack(x, np.int64) for x in part["grams"][0].as_py()])  # by bucket, as the answers
        logp = np.concatenate([unpack(x, np.float32) for x in answers.sort_by("bucket")["logp"].to_pylist()])
        order = np.argsort(grams)
        grams, logp = grams[order], logp[order]
        out = []
        with pa.ipc.open_stream(part["body"][0].as_buffer()) as body:
            for whole in body:
                if len(whole):
                    out.append(one(whole, grams, logp, known, often))
        return pa.Table.from_batches(out)

    asking = parts.filter("body IS NOT NULL").select("part", "body", "grams")
    rows = asking.groupBy("part").cogroup(answer(parts, fit(parts)).groupBy("part")).applyInArrow(run, SCORED)
    rows = stash(rows.withColumn("__row", F.monotonically_increasing_id()), "scored")
    tail = rows.select("__row", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("__row", F.col("x.words").alias("word"), F.col("x.counts").alias("k"))
    tail = tail.join(words, "word", "left").groupBy("__row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).alias("tail_sum"), F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("tail_known")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    norm = float(np.log10(n_train + SMOOTHING * (n_distinct + 1)))
    end = float(np.log10(ends + SMOOTHING))
    return rows.drop("words", "counts").join(tail, "__row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + zero("tail_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("head_sum") + zero("tail_sum") + F.lit(end) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
        "bits_per_byte",
    )


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 10 is not 0 and scores all."""
    docs = table(spark, sf_dir, "documents")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    out = score(docs, remainder != 0)
    return out.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
