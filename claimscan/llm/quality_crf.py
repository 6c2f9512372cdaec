"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. The score of a line sums a weight for each of its features' levels and for
those of the lines before and after it; a transition weight joins neighbours. Training maximises the
likelihood of the labels (each line of a labelled document has its document's), with the exact gradient
from forward-backward sums. A document's score is the length-weighted mean of its lines' marginals.

Forward and backward sums are prefix products of 2x2 matrices in log space, taken by doubling over many
lines at once, so that a text of very many lines is no slower than many short ones. Scoring does so for BLOCK
lines at a time and hands the messages on from block to block, so a text of any number of lines takes a few dozen
bytes a line; a line's levels are one byte a feature.

Training takes a bounded sample: the TRAIN_DOCS labelled documents with the smallest hash of doc_id. If they have more than
TRAIN_LINES lines together, each gives its first lines, as many for each as the greatest equal share that fits, so
that a long text displaces no other.

Cases: a null or empty text has one empty line, which is scored as such; lines weigh their length in
bytes plus one; rows without doc_id are scored; a document with several labels takes the least; without
labels every score is 0.5; an empty table gives an empty result. Further columns are ignored, also such
that bear the name of a result column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import NOT_SPACE, buffers, chunks, codes, split_words
from ._work import in_arrow, stash, table

TRAIN_DOCS = 4000
TRAIN_LINES = 100_000
STEPS, RATE, PENALTY = 120, 0.3, 1e-3
CHUNK = 4 << 20
#: Lines whose messages are computed at a time in scoring.
BLOCK = 1 << 12
THRESHOLD = 0.3

#: Byte classes whose share of a line is a feature.
CLASSES = {
    "symbol": b"#*$%&<>",
    "pipe": b"|",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "bang": b"!?",
    "stop": b".,;:",
    "space": b" \t\v\f\r",
    "other": bytes(range(128, 256)),
}
FEATURES = [*CLASSES, "repeated", "distinct", "word_length", "length", "duplicate", "edges"]
#: Levels of a share: how many of these it exceeds.
CUTS = np.array([0.0, 0.01, 0.03, 0.07, 0.15, 0.3, 0.5, 0.75, 0.95])
LEVELS = len(CUTS) + 1
#: Beyond a document's first and last line.
NONE = LEVELS


def line_levels(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The level of each feature of each line (lines x features), the lines' bytes, and each text's first line."""
    data, offsets = buffers(column)
    breaks = np.flatnonzero(data == 10)
    n_docs = len(offsets) - 1
    before = np.searchsorted(breaks, offsets)
    first = before + np.arange(n_docs + 1)
    n = int(first[-1])
    starts, ends = np.empty(n, np.int32), np.empty(n, np.int32)  # a column has less than 2 GB
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[first[:-1]] = True
    is_last[first[1:] - 1] = True
    starts[is_first], starts[~is_first] = offsets[:-1], breaks + 1
    ends[is_last], ends[~is_last] = offsets[1:], breaks
    size = ends - starts

    def inside(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, dtype=np.int32)
        np.cumsum(mask, out=total[1:])
        return total

    levels = np.empty((n, len(FEATURES)), dtype=np.uint8)

    def put(j: int, share: np.ndarray) -> None:
        levels[:, j] = np.searchsorted(CUTS, share, "left")

    for j, members in enumerate(CLASSES.values()):
        table = np.zeros(256, dtype=bool)
        table[list(members)] = True
        total = inside(table[data])
        put(j, (total[ends] - total[starts]) / np.maximum(size, 1))
    words = split_words(data, offsets, NOT_SPACE, lower=False)
    code, distinct = codes(words.words)
    a, b = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    n_words = b - a
    again = inside(np.concatenate([[False], code[1:] == code[:-1]])[: len(code)])
    j = len(CLASSES)
    put(j, (again[b] - again[np.minimum(a + 1, b)]) / np.maximum(n_words, 1))
    line = np.repeat(np.arange(n), n_words)
    pairs = np.unique(line * max(1, len(distinct)) + code) if len(code) else np.zeros(0, np.int64)
    put(j + 1, np.bincount(pairs // max(1, len(distinct)), minlength=n) / np.maximum(n_words, 1))
    put(j + 2, size / np.maximum(n_words, 1) / 20)
    put(j + 3, np.log1p(size) / 9)
    del line, pairs, again, words, code, a, b, n_words
    at = np.concatenate([[0], np.cumsum(size)])  # without the line ends, so that a text's last line equals an earlier one
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(data[data != 10])])
    same, kinds = codes(whole)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    seen = np.ones(n, dtype=bool)
    seen[np.unique(doc * max(1, len(kinds)) + same, return_index=True)[1]] = False
    put(j + 4, seen)
    del same, doc, seen, whole
    padded = np.append(data, 0)
    head, tail = padded[np.minimum(starts, len(data))], padded[np.maximum(ends - 1, 0)]
    put(j + 5, np.where(size > 0, 0.2 * ((head >= 65) & (head <= 90)) + 0.6 * np.isin(tail, list(b".!?")), 1.0))
    return levels, size, first


class Chain:
    """Weights: level scores of the line before, the line, and the line after; a bias; 2x2 transitions. Positive is good."""

    SHAPE = (3, len(FEATURES), LEVELS + 1)

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros(int(np.prod(self.SHAPE)) + 5) if weights is None else weights

    @staticmethod
    def places(levels: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Indexes of the weights that each line's score sums."""
        edge = np.full((1, levels.shape[1]), NONE, dtype=levels.dtype)
        up, down = np.vstack([edge, levels[:-1]]), np.vstack([levels[1:], edge])
        up[first[:-1]] = NONE
        down[first[1:] - 1] = NONE
        shape = Chain.SHAPE
        feature = np.arange(shape[1]) * shape[2]
        return np.hstack([x + feature + k * shape[1] * shape[2] for k, x in enumerate((up, levels, down))])

    def marginals(self, places: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line; the expected transitions (2x2); log Z of each document."""
        score = self.weights[places].sum(axis=1) + self.weights[-5]
        trans = self.weights[-4:].reshape(2, 2)
        n = len(score)
        node = np.stack([np.zeros(n), score], axis=1)
        step = trans[None] + node[:, None, :]  # from, to
        inner = np.arange(n) - np.repeat(first[:-1], np.diff(first))
        step[inner == 0] = node[inner == 0][:, None, :]
        forward = _products(step, inner)[:, 0, :]
        last = np.repeat(first[1:] - 1, np.diff(first)) - np.arange(n)
        onward = np.zeros((n, 2, 2))
        onward[:-1] = step[1:]
        onward[last == 0] = np.where(np.eye(2, dtype=bool), 0.0, -np.inf)
        # backward sums are products towards the end: mirrored and transposed they are products from a start
        mirrored = _products(onward[::-1].transpose(0, 2, 1), last[::-1])[::-1]
        backward = np.logaddexp(mirrored[:, 0, :], mirrored[:, 1, :])
        both = forward + backward
        log_z = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - log_z)
        pair = np.flatnonzero(inner > 0)
        joint = forward[pair - 1][:, :, None] + step[pair] + backward[pair][:, None, :] - log_z[pair, None, None]
        return good, np.exp(joint).sum(axis=0), log_z[first[:-1]]


    def good_lines(self, levels: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(good) of each line, as ``marginals`` gives it, for BLOCK lines at a time: forward messages up to each block, then backward ones."""
        weights = self.weights[:-5].reshape(self.SHAPE)
        trans = self.weights[-4:].reshape(2, 2)
        n = len(levels)
        is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
        is_first[first[:-1]] = True
        is_last[first[1:] - 1] = True

        score = np.full(n, self.weights[-5])

        def add_up(a: int, b: int) -> None:
            total = score[a:b]
            for k, (edge, move) in enumerate(((is_first, -1), (None, 0), (is_last, 1))):
                own = levels[np.clip(np.arange(a, b) + move, 0, n - 1)]
                if edge is not None:
                    own[edge[a:b]] = NONE
                for j in range(own.shape[1]):
                    total += weights[k, j][own[:, j]]

        def steps(a: int, b: int) -> np.ndarray:
            """Log weights from a line's predecessor to it; a first line has none."""
            out = np.zeros((b - a, 2, 2))
            out[:, :, 1] = score[a:b, None]
            out += np.where(is_first[a:b, None, None], 0.0, trans)
            return out

        def places(edge: np.ndarray) -> np.ndarray:
            """Each line's place after the last edge before it, or after the block's start."""
            at = np.arange(len(edge))
            return at - np.maximum.accumulate(np.where(edge, at, 0))

        forward = np.empty((n, 2))
        message = np.zeros(2)
        edges = [(a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)]
        for a, b in edges:
            add_up(a, b)
            step = steps(a, b)
            if not is_first[a]:
                step[0] = np.logaddexp(message[0] + step[0, 0], message[1] + step[0, 1])
            part = _products(step, places(is_first[a:b]))[:, 0, :]
            forward[a:b] = part - part.max(axis=1, keepdims=True)
            message = forward[b - 1]
        good = np.empty(n)
        message = np.zeros(2)
        for a, b in reversed(edges):
            onward = np.zeros((b - a, 2, 2))
            onward[:-1] = steps(a + 1, b) if b - a > 1 else 0.0
            if b < n:
                onward[-1] = steps(b, b + 1)[0] + message  # to the next block's first line, and on from there
            onward[is_last[a:b]] = np.where(np.eye(2, dtype=bool), 0.0, -np.inf)
            turned = onward[::-1].transpose(0, 2, 1)
            if b < n and not is_last[b - 1]:
                turned[0] = np.logaddexp(turned[0, 0], turned[0, 1])
            elif not is_last[b - 1]:
                turned[0] = 0.0
            part = _products(turned, places(is_last[a:b][::-1]))[::-1]
            backward = np.logaddexp(part[:, 0, :], part[:, 1, :])
            both = forward[a:b] + backward
            good[a:b] = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
            message = backward[0] - backward[0].max()
        return good


def _products(m: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Log-space prefix products within runs; ``inner`` is the place in the run."""
    m = m.copy()
    k = 1
    while (at := np.flatnonzero(inner >= k)).size:
        a, b = m[at - k], m[at]
        m[at] = np.logaddexp(a[:, :, 0, None] + b[:, None, 0, :], a[:, :, 1, None] + b[:, None, 1, :])
        k *= 2
    return m


def train(levels: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Chain:
    """Maximum likelihood with an L2 penalty, by Adam on the full gradient."""
    chain = Chain()
    places = Chain.places(levels, first)
    n_docs, w = len(label), chain.weights
    y = np.repeat(label, np.diff(first))
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (np.diff(first)[label == k] - 1).sum()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        good, joint, _ = chain.marginals(places, first)
        error = y - good
        g = np.bincount(places.ravel(), weights=np.repeat(error, places.shape[1]), minlength=len(w))
        g[-5], g[-4:] = error.sum(), (seen - joint).ravel()
        g = g / n_docs - PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += RATE * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return chain


def _levels(batches):
    for whole in batches:
        for batch in chunks(whole, "text", CHUNK):
            levels, size, first = line_levels(batch.column("text"))
            flat = pa.array(levels.tobytes()[i * levels.shape[1] : j * levels.shape[1]] for i, j in zip(first[:-1], first[1:], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("doc_id"), flat.cast(pa.binary())], ["quality", "doc_id", "levels"])


def equal_share(sizes: dict[int, int], limit: int) -> int:
    """The most lines that each of so many documents by number of lines may give for at most ``limit`` together; one at least."""
    left, docs = limit, sum(sizes.values())
    for lines in sorted(sizes):
        if lines * docs > left:
            return max(1, left // docs)
        left, docs = left - lines * sizes[lines], docs - sizes[lines]
    return max(sizes, default=1)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES) -> Chain | None:
    """Learn from ``labels`` (doc_id, quality) on a bounded sample; None without any label."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.least(F.greatest(F.min("quality"), F.lit(0)), F.lit(1)).cast("int").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    sample = stash(known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs), "sample")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = stash(in_arrow(own, _levels, "quality int, doc_id long, levels binary"), "levels")
    width = len(FEATURES)
    sizes = rows.groupBy((F.octet_length("levels") / width).cast("long").alias("lines")).count().collect()
    share = equal_share({r["lines"]: r["count"] for r in sizes}, max_lines)
    table = rows.withColumn("levels", F.substring("levels", 1, share * width)).orderBy(F.xxhash64("doc_id"), "doc_id", "levels").limit(max_lines).toArrow()
    if not len(table):
        return None
    raw = table["levels"].to_pylist()
    levels = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, width)
    first = np.concatenate([[0], np.cumsum([len(x) // width for x in raw])])
    return train(levels, first, table["quality"].to_numpy().astype(np.int64))


def score(docs: DataFrame, chain: Chain | None, with_lines: bool = False) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; with the P(good) of each line, if wanted."""
    sent = docs.sparkSession.sparkContext.broadcast(None if chain is None else chain.weights)

    def run(batches):
        chain = None if sent.value is None else Chain(sent.value)
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK):
                levels, size, first = line_levels(batch.column("text"))
                good = chain.good_lines(levels, first) if chain else np.full(len(size), 0.5)
                weight = size + 1.0
                mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
                out = [batch.column("doc_id"), pa.array(np.clip(mean, 0, 1))]
                if with_lines:
                    out.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(good)))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "lines"][: len(out)])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double" + ", lines array<double>" * with_lines)


def op4_quality_crf(spark, sf_dir: str) -> DataFrame:
    """Learns from the labels of rows whose crc32(doc_id) mod 5 is not 0 and scores all documents."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    chain = fit(docs, labels.filter(remainder != 0))
    held = F.coalesce(remainder == 0, F.lit(False)).alias("held_out")
    return score(docs, chain).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
