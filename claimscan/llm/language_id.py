"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting: every task adds up its documents' n-grams by language and bucket; the sums are added up by a
shuffle of at most languages x buckets rows a task. Scoring: the matrix of log-probabilities is sent to
the tasks, and the n-grams of a batch of documents are looked up and summed in numpy.

A matrix has at most ``MAX_LANGS`` languages, so what is sent to the tasks is bounded. If there are more, each matrix scores all
texts in a pass of its own; the best language and the sum over languages are carried from pass to pass.
Looked-up log-probabilities are summed for CELLS of them at a time (pieces of a text, in its order), so a long text times many
languages is never held at once.

Cases: a null text or one without a letter is ``und`` with score 0, and so is every text if there is
nothing to learn from; ties go to the language that sorts first; rows without doc_id are scored, but
not learned from; repeated rows count as often as they occur; an empty table gives an empty result.
Further columns are ignored, also such that bear the name of a result column.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import buffers, chunks
from ._work import in_arrow, stash, table

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
MAX_LANGS = 256
SMOOTHING = 0.5
CHUNK = 1 << 20
CELLS = 4 << 20
SPACE = 32
#: The pipeline keeps documents whose language is at least so probable.
MIN_SCORE = 0.5

COUNTS = "lang string, bucket int, n long"


@cache
def letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else a space."""
    out = np.full(0x110000, SPACE, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, one number a character, and the offset of each text."""
    data, offsets = buffers(column)
    begins = (data & 0xC0) != 0x80
    at = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum([np.count_nonzero(begins[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], out=at[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return letters()[points], at


def pieces(at: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """The texts cut at every ``limit`` characters, in blocks of at most ``limit`` characters: (text, start of each piece, block's start and end)."""
    sizes = np.diff(at)
    n = -(-sizes // limit)
    text = np.repeat(np.arange(len(sizes)), n)
    starts = at[:-1][text] + limit * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    edges = np.append(starts, at[-1])
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + limit, "right")) - 1)
        yield text[i:j], starts[i:j], int(edges[i]), int(edges[j])
        i = j


def block_buckets(chars: np.ndarray, at: np.ndarray, a: int, b: int, order: int, bits: int) -> np.ndarray:
    """``buckets`` of the characters from ``a`` to ``b``, whose n-grams may reach beyond."""
    end = min(len(chars), b + order - 1)
    i, j = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, end, "left")
    return buckets(chars[a:end], np.clip(at[i : j + 1], a, end) - a, order, bits)[: b - a]


def buckets(chars: np.ndarray, at: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each character; 2**bits where it would pass its text's end."""
    n = len(chars)
    h = np.full(n, order, dtype=np.uint32) * np.uint32(0x9E3779B1)
    for k in range(order):
        h[: n - k] = (h[: n - k] ^ chars[k:]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    out = ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)).astype(np.int64)
    for k in range(1, order):
        last = at[1:] - k
        out[last[last >= at[:-1]]] = 1 << bits
    return out


def count(docs: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """(lang, bucket, n) over ``docs`` (lang, text); bucket -1 has the number of documents."""

    def add(batches):
        held: dict[str, np.ndarray] = {}

        def rows():
            for lang, n in held.items():
                there = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(there)), pa.array(there.astype(np.int32) - 1), pa.array(n[there])], ["lang", "bucket", "n"]
                )

        for whole in batches:
            for batch in chunks(whole, "text", CHUNK):
                names = batch.column("lang").to_pylist()
                distinct = sorted(set(names))
                own = np.array([distinct.index(x) for x in names])
                chars, at = characters(batch.column("text"))
                size = (1 << bits) + 1
                total = np.zeros((len(distinct), size), dtype=np.int64)
                for text, starts, a, b in pieces(at, CELLS):
                    which = np.repeat(own[text] * size, np.diff(np.append(starts, b)))
                    for order in ORDERS:
                        total += np.bincount(which + block_buckets(chars, at, a, b, order, bits), minlength=total.size).reshape(total.shape)
                for i, lang in enumerate(distinct):
                    n = held.setdefault(lang, np.zeros(size, dtype=np.int64))
                    n[1:] += total[i, :-1]
                    n[0] += (own == i).sum()
                if len(held) > 64:
                    yield from rows()
                    held.clear()
        yield from rows()

    return in_arrow(docs.select("lang", "text"), add, COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Some languages, in order: ``matrix`` has the log probability of each bucket, and 0 in its last row; ``prior`` of each language."""

    def __init__(self, langs: list[str], bits: int, matrix: np.ndarray, prior: np.ndarray):
        self.langs, self.bits, self.matrix, self.prior = langs, bits, matrix, prior


def fit(docs: DataFrame, max_langs: int = MAX_LANGS) -> list[Model]:
    """Learn from all of ``docs`` (lang, text); rows without either are left out."""
    counts = stash(count(docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")), "counts")
    sizes = {r.lang: r.n for r in counts.filter("bucket = -1").select("lang", "n").collect()}
    models = []
    for i in range(0, len(sizes), max_langs):
        langs = sorted(sizes)[i : i + max_langs]
        rows = counts.filter((F.col("bucket") >= 0) & (F.col("lang") >= langs[0]) & (F.col("lang") <= langs[-1])).toArrow()
        grams = np.full((len(langs), 1 << BUCKET_BITS), SMOOTHING)
        where = {x: k for k, x in enumerate(langs)}
        grams[np.array([where[x] for x in rows["lang"].to_pylist()], dtype=np.int64), rows["bucket"].to_numpy()] += rows["n"].to_numpy()
        matrix = np.zeros(((1 << BUCKET_BITS) + 1, len(langs)))
        matrix[:-1] = np.log(grams / grams.sum(axis=1, keepdims=True)).T
        prior = np.log(np.array([sizes[x] for x in langs]) / sum(sizes.values()))
        models.append(Model(langs, BUCKET_BITS, matrix, prior))
    return models


def log_probabilities(column: pa.Array, model: Model) -> np.ndarray:
    """Texts x languages: log of prior times likelihood; -inf for a text without a letter."""
    chars, at = characters(column)
    total = np.tile(model.prior, (len(column), 1))
    full = np.flatnonzero(np.diff(at) > 0)
    worded = np.zeros(len(column), dtype=bool)
    if len(full):
        worded[full] = np.logical_or.reduceat(chars != SPACE, at[full])
        for text, starts, a, b in pieces(at, max(1, CELLS // len(model.langs))):
            for order in ORDERS:
                found = model.matrix[block_buckets(chars, at, a, b, order, model.bits)]
                np.add.at(total, text, np.add.reduceat(found, starts - a, axis=0))
    total[~worded] = -np.inf
    return total


def predict(docs: DataFrame, models: list[Model], columns: list[str] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text), and the given further columns."""
    extra = [c for c in columns if c not in ("doc_id", "lang_pred", "score")]
    names = ["doc_id", "text", *[c for c in docs.columns if c != "text" and c in extra]]
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *names[1:], F.lit(None).cast("string").alias("__best"), F.lit(float("-inf")).alias("__top"), F.lit(float("-inf")).alias("__sum"))

    def one_pass(model: Model):
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            model = sent.value
            for whole in batches:
                for batch in chunks(whole, "text", CHUNK):
                    total = log_probabilities(batch.column("text"), model)
                    place = total.argmax(axis=1)
                    top, was = total[np.arange(len(batch)), place], batch.column("__top").to_numpy()
                    with np.errstate(invalid="ignore"):
                        here = np.where(top > -np.inf, top + np.log(np.exp(total - top[:, None]).sum(axis=1)), -np.inf)
                    best = [model.langs[k] if a > b else old for k, a, b, old in zip(place, top, was, batch.column("__best").to_pylist(), strict=True)]
                    carried = [pa.array(best, pa.string()), pa.array(np.maximum(top, was)), pa.array(np.logaddexp(here, batch.column("__sum").to_numpy()))]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *carried], [*names, "__best", "__top", "__sum"])

        return run

    for i, model in enumerate(models):
        state = in_arrow(stash(state, "scored") if i else state, one_pass(model), state.schema)
    score = F.when(F.col("__best").isNull(), 0.0).otherwise(F.least(F.exp(F.col("__top") - F.col("__sum")), F.lit(1.0)))
    return state.select("doc_id", F.coalesce("__best", F.lit("und")).alias("lang_pred"), score.alias("score"), *extra)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 4 is not 2 and predicts all."""
    docs = table(spark, sf_dir, "documents")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    models = fit(docs.filter(remainder != 2))
    held = F.coalesce(remainder == 2, F.lit(False)).alias("held_out")
    return predict(docs, models).select("doc_id", held, "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a recognised language; learns from the rows op10 learns from."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    models = fit(docs.filter(remainder != 2))
    rows = docs.select(F.struct("*").alias("document"), F.lit(None).cast("long").alias("doc_id"), "text")
    scored = predict(rows, models, ["document"])
    return scored.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("document.*")
