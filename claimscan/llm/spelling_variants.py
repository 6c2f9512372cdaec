"""Groups of spelling variants: words one insertion, deletion or replacement apart, found over sorted permuterm rotations.

A word is marked with a terminator and rotated to start at every place. A rotation that ends in the edited character says all of the word
but that character in what is before it: ``s$p`` of ``p?s``. Words that differ by one replacement there share this prefix, and the word that lacks the character
has it as a whole rotation. So every word gives its whole rotations, and the prefixes of those that end in a letter; all are sorted by range, and equal
ones lie in a run: at most one whole rotation, and one prefix for each letter of the alphabet. A scan of the sorted runs tells every member how many
others are near it and which is the most frequent; no pair is written, and no run is longer than the alphabet and one.

A deletion from a run of equal letters gives the same word at each of its places; it counts at the first only, so that every near pair is met in one run.

A word's form is its most frequent near word, if that is ``times`` more frequent; forms are more frequent each time, so they lead to a root, which is
found by doubling the steps.

Cases: a null or empty text has no words; a null doc_id counts as empty; repeated rows count each; an empty table gives an empty result. A very long
text is handled in one piece, word by word. Further columns are ignored, also such that bear the name of a result column.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import in_arrow, stash, table

LEAST, TIMES = 7, 10
#: Marks the end of a word; must not be a letter of one.
END = "$"
#: A run whose hash this divides loses a letter.
TYPO = 31
#: Distinct words that a task counts before it sends them.
HELD = 200_000
#: Kinds of entries in the order they are looked at: a whole rotation, a prefix whose letter is the first of equal ones, another prefix.
WHOLE, FIRST, LATER = 0, 1, 2

RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST)


def words_of(doc_id, text: str) -> Counter:
    """The words of a document by the rule of the query: lower-cased runs, some of which lose a letter that their hash tells."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text)).items():
        word = run.encode().lower()  # of bytes: A to Z only
        h = zlib.crc32(word, start)
        if h % TYPO:
            out[word.decode()] += n
        elif len(run) > LEAST:
            at, lower = h % len(run), word.decode()
            out[lower[:at] + lower[at + 1 :]] += n
    return out


def count_words(docs: DataFrame, least: int = 2) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text) with n >= ``least``; tasks send counts."""

    def counted(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if text.is_valid:
                    total.update(words_of(doc_id, text.as_py()))
                if len(total) >= HELD:
                    yield counted(total)
                    total = Counter()
        yield counted(total)

    return in_arrow(docs.select("doc_id", "text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """(key, kind, word, n): the whole rotations of each word, and those less the letter they end in."""
    size = F.length("word")
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.concat(F.substr("word", i + 1), F.lit(END), F.substr("word", F.lit(1), i)).alias("key"), F.lit(WHOLE).alias("kind")))
    letter = lambda i: F.substr("word", i, F.lit(1))
    kind = lambda i: F.when((i == 0) | (letter(i) != letter(i + 1)), FIRST).otherwise(LATER)
    less = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.concat(F.substr("word", i + 2), F.lit(END), F.substr("word", F.lit(1), i)).alias("key"), kind(i).alias("kind")))
    return words.filter(size > 0).select("word", "n", F.explode(F.concat(whole, less)).alias("x")).select("x.key", "x.kind", "word", "n")


def _met(rows: pa.Table) -> pa.RecordBatch:
    """(word, n_near, near, near_n) for every row (group, kind, word, n) that has a near word in its run: their number and the best of them."""
    rows = rows.take(pc.sort_indices(rows, [("group", "ascending"), ("n", "descending"), ("word", "ascending")]))  # the better of two comes first
    group, kind = rows["group"].to_numpy(), rows["kind"].to_numpy()
    n, none = int(group[-1]) + 1 if len(group) else 0, len(group)

    def first(at: np.ndarray) -> np.ndarray:
        out = np.full(n, none)
        out[group[at][::-1]] = at[::-1]
        return out

    edited, flagged, whole = np.flatnonzero(kind != WHOLE), np.flatnonzero(kind == FIRST), np.flatnonzero(kind == WHOLE)
    best, best_flagged, best_whole = first(edited), first(flagged), first(whole)
    second = first(edited[np.diff(group[edited], prepend=-1) == 0])
    count = lambda at: np.bincount(group[at], minlength=n)
    row = np.arange(none)
    other = np.where(best[group] == row, second[group], best[group])
    other = np.where(kind == FIRST, np.minimum(other, best_whole[group]), other)
    other = np.where(kind == WHOLE, best_flagged[group], other)
    near = np.where(kind == WHOLE, count(flagged)[group], count(edited)[group] - 1 + (kind == FIRST) * count(whole)[group])
    keep = np.flatnonzero(near > 0)
    to = pa.array(other[keep])
    return pa.RecordBatch.from_arrays([_flat(rows["word"].take(pa.array(keep))), pa.array(near[keep]), _flat(rows["word"].take(to)), _flat(rows["n"].take(to))], ["word", "n_near", "near", "near_n"])


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def scan(sorted_rows: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) for each run of equal keys in rows (key, kind, word, n) that are sorted within partitions."""

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            # the last run may go on in the next batch
            differs = np.flatnonzero(pc.not_equal(_flat(rows["key"].slice(1)), _flat(rows["key"].slice(0, len(rows) - 1))).to_numpy(zero_copy_only=False)) + 1
            cut = int(differs[-1]) if len(differs) else 0
            held = rows.slice(cut)
            yield from runs(rows.slice(0, cut), differs)
        if held is not None:
            yield from runs(held, np.array([len(held)]))

    def runs(rows: pa.Table, ends: np.ndarray):
        if not len(rows):
            return
        size = np.diff(ends, prepend=0)
        keep = np.flatnonzero(np.repeat(size > 1, size))  # most are alone
        if len(keep):
            group = np.repeat(np.arange((size > 1).sum()), size[size > 1])
            yield _met(rows.take(pa.array(keep)).drop_columns(["key"]).append_column("group", pa.array(group)))

    return in_arrow(sorted_rows, run, "word string, n_near long, near string, near_n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): how many near words each of ``words`` (word, n; distinct) has that has any, and the most frequent, the first of equals."""
    entries = stash(rotations(words), "rotations")
    met = scan(entries.repartitionByRange("key").sortWithinPartitions("key"))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.near", "best.near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of the forms from each word on. Each round doubles the steps."""
    links = stash(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = links.join(ahead, "root", "left")
        after = stash(longer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
        if not after.filter("moved").limit(1).count():
            return after.select("word", "root")
        links = after.drop("moved")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of written ``words`` (word, n; distinct)."""
    near = words.join(near_words(words), "word", "left")
    has_form = F.col("near_n") >= F.col("n") * times
    found = stash(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("near")).alias("form"), F.when(has_form, F.col("near_n")).alias("form_n")), "near")
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """All words of ``documents`` with their near words."""
    return variants(stash(count_words(table(spark, sf_dir, "documents")), "words"))


OP11_SQL = rf"""
WITH RECURSIVE
crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT id, run, count(*) AS n FROM (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{{LEAST},}}'), lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents
) GROUP BY id, run),
bytes AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, CAST(b AS BIGINT[])), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM bytes, crc),
edited AS (SELECT CASE WHEN h % {TYPO} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= 2),
e AS (SELECT word, n, left(word, i) || '$' || substr(word, i + 2) AS k, i = 0 OR substr(word, i, 1) <> substr(word, i + 1, 1) AS first FROM (SELECT *, unnest(range(length(word)))::INT AS i FROM words)),
v AS (SELECT word, n, left(word, i) || '$' || substr(word, i + 1) AS k FROM (SELECT *, unnest(range(length(word) + 1))::INT AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM e a JOIN e b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT e.word, v.word, v.n FROM e JOIN v ON e.k = v.k AND e.first
  UNION ALL SELECT v.word, e.word, e.n FROM e JOIN v ON e.k = v.k AND e.first
),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS form, max(n) AS form_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, CASE WHEN b.form_n >= {TIMES} * w.n THEN b.form END AS form, CASE WHEN b.form_n >= {TIMES} * w.n THEN b.form_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
way AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT way.word, f.form FROM way JOIN f ON way.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT way.word, way.at FROM way JOIN f ON way.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, coalesce(ends.at, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ends ON f.word = ends.word
"""
