"""Quality rules per document and per host, in DataFrame functions only.

Each document is measured by itself (words, symbols, repeated lines and repeated 5-word windows) and
fails or passes the base rules. The failures are then counted per host; a host's rate is shrunk
towards the other hosts by a beta prior fitted to all hosts' rates (method of moments), and a host
whose shrunk rate exceeds a limit fails with all its documents.

Cases: a null text has no words (so the document fails); a null host is a host of its own, the empty
name; repeated rows are counted as often as they occur; an empty table gives an empty result; columns
that bear the name of a result column are replaced by it (the pipeline stage returns all columns as they came).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import small_side, stash

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = [*MEASURES, "base_failed", "host_docs", "host_fails", "host_rate", "host_failed", "kept"]

#: A host fails if its shrunk rate of failed documents is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
MIN_PRIOR, MAX_PRIOR = 1.0, 1e6
#: Host verdicts are broadcast up to so many hosts and joined by a shuffle beyond that.
BROADCAST_HOSTS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of 5 that the array holds twice or more.

    The windows are compared by 64-bit hashes. Most texts repeat none, which a set of their hashes
    tells; else the windows are sorted by hash and position, those with an equal neighbour are kept,
    and the lengths of the intervals they cover are summed.
    """

    def covered(at: Column) -> Column:
        gap = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda s, x: s + x)

    def slow(grams: Column) -> Column:
        def pick(s: Column) -> Column:
            same = F.transform(
                s,
                lambda x, i: F.when((F.get(s, i - 1)["g"] == x["g"]) | (F.get(s, i + 1)["g"] == x["g"]), x["i"]),
            )
            return let(F.array_sort(F.filter(same, lambda x: x.isNotNull())), covered)

        return let(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), pick)

    def of(hashed: Column) -> Column:
        n = F.size(hashed) - (WINDOW - 1)
        grams = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW)]))
        some = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(slow(g)))
        return F.when(n < 2, F.lit(0).cast("long")).otherwise(some)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def word_counts(text: Column) -> Column:
    """A struct of ``n_words`` and ``n_repeat_words``."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")
    return let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))


def base_fails(w: Column) -> Column:
    """The base rules, of a struct that ``word_counts`` gave."""
    return (w["n_words"] < 10) | (w["n_repeat_words"] * 100 > w["n_words"] * 20)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures of every whole text and ``base_failed``."""
    names = [c for c in docs.columns if c not in (*MEASURES, "base_failed")]
    t = F.coalesce(F.col("t"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    w = F.col("w")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("t"))
    return rows.withColumn("w", word_counts(F.col("t"))).select(
        "row.*",
        w["n_words"].alias("n_words"),
        F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"),
        w["n_repeat_words"].alias("n_repeat_words"),
        base_fails(w).alias("base_failed"),
    )


def host_verdicts(measured: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate and ``host_failed``.

    With mean m and variance v of the hosts' rates, the prior weighs k = m(1-m)/v - 1 documents (within
    MIN_PRIOR and MAX_PRIOR; the latter if the rates are all alike) and the shrunk rate is
    (failures + k*m) / (documents + k).
    """
    hosts = measured.groupBy(F.coalesce(F.col(host), F.lit("")).alias("__host")).agg(
        F.count("*").alias("host_docs"), F.count_if(F.col("base_failed")).alias("host_fails")
    )
    prior = hosts.agg(F.avg(F.col("host_fails") / F.col("host_docs")).alias("m"), F.var_pop(F.col("host_fails") / F.col("host_docs")).alias("v"))
    k = F.when(F.col("v") > 0, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(MIN_PRIOR)), F.lit(MAX_PRIOR))).otherwise(MAX_PRIOR)
    rate = (F.col("host_fails") + F.col("k") * F.col("m")) / (F.col("host_docs") + F.col("k"))
    one = prior.select("m", k.alias("k"))  # a single row
    return hosts.join(F.broadcast(one)).select("__host", "host_docs", "host_fails", rate.alias("host_rate"), (rate > max_rate).alias("host_failed"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE, columns: list[str] | None = None) -> DataFrame:
    """Adds the measures, the host's figures and ``kept`` to ``columns`` (all, unless given) of every row.

    The measured rows are written once, so that texts are not measured again for the join.
    """
    columns = [c for c in (columns or docs.columns) if c not in RESULTS]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce(F.col(host), F.lit("")).alias("__host"), F.col(text).alias("text"))
    measured = stash(measure(rows).drop("text"), "measured")
    verdicts = small_side(stash(host_verdicts(measured, "__host", max_rate), "hosts"), BROADCAST_HOSTS)
    kept = ~F.col("base_failed") & ~F.col("host_failed")
    return measured.join(verdicts, "__host").select("row.*", *[c for c in RESULTS if c != "kept"], kept.alias("kept"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(docs, columns=["doc_id"])
    return out.select("doc_id", *MEASURES, "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep.

    No document is written before the result: a first pass writes each row's host and whether it failed, a second one judges
    the texts anew and drops the failed hosts. Either counts words only; both take 1.4 times as long as all the measures once.
    """
    host, failed = F.coalesce(F.col("source"), F.lit("")), let(word_counts(F.col("text")), base_fails)
    judged = stash(docs.select(host.alias("__host"), failed.alias("base_failed")), "judged")
    gone = stash(host_verdicts(judged, "__host").filter("host_failed").select("__host"), "failed_hosts")
    rows = docs.select(F.struct("*").alias("document"), host.alias("__host"), "text").filter(~failed)
    return rows.join(small_side(gone, BROADCAST_HOSTS), "__host", "left_anti").select("document.*")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), lines AS (
  SELECT rid, len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)
), g AS (
  SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1)
  GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN lines ON lines.rid = w.rid LEFT JOIN rep ON rep.rid = w.rid
), f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS x FROM f GROUP BY host
), p AS (
  SELECT avg(x / n) AS mean, var_pop(x / n) AS v FROM h
), k AS (
  SELECT mean, CASE WHEN v > 0 THEN least(greatest(mean * (1 - mean) / v - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM p
), r AS (
  SELECT host, (x + k.k * k.mean) / (n + k.k) AS rate FROM h, k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT rate > 0.5) AS kept, round(rate, 6) AS host_rate
FROM f JOIN r ON r.host = f.host
"""
