"""Stand-in inputs for the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_710_000_000

#: Dictionary of the documents' abusive words, with the category families in turn; the last two meet spans of earlier rules.
WORDS = ["trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic", "loser", "disgusting", "stupid", "TRASH", "hing of"]
CATEGORIES = ["极限用语", "虚假宣传", "对比贬低", "行业禁区", "其他"]

#: ASCII patterns in place of the default pack, as the documents are invented European prose.
SIGNALS = {
    "marketing": "thin",
    "personal": "eaer",
    "objective": "oron",
    "qualifier": "stre",
    "backed": "whed",
    "quantified": "[0-9]",
    "guarantee": "andly",
    "cure": "shed",
    "ingredient": "ouan",
    "feeling": "wher",
    "denigrating": "scum|trash",
    "named": "ndor",
    "data": "edst",
    "illness": "loser",
    "finance": "idiot",
    "education": "clown",
    "natural": "stupid",
    "word_of_mouth": "hean",
    "comparing": "reti",
    "sales": "tiou",
}

PATTERNS = [("law", 3, "ation"), ("law", 2, "erth"), ("law", 1, "the"), ("case", 3, "eau"), ("case", 2, "les"), ("case", 1, "ment"), ("rule", 3, "ung"), ("rule", 2, "ción"), ("rule", 1, "der|la")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, w, w, CATEGORIES[i % len(CATEGORIES)], f"art {i}") for i, w in enumerate(WORDS)]
    return spark.createDataFrame(rows, "rule_idx int, word string, pattern string, category string, regulation_ref string")


RULES_SQL = "(VALUES " + ", ".join(f"({i}, '{w}', '{CATEGORIES[i % len(CATEGORIES)]}', 'art {i}')" for i, w in enumerate(WORDS)) + ") AS r(rule_idx, word, category, ref)"

#: Common table expressions: every hit of every literal rule, its span owned by the earliest.
HITS_SQL = f"""
parts AS (
  SELECT d.doc_id, d.text, r.*, string_split(lower(d.text), lower(r.word)) AS p FROM documents d JOIN {RULES_SQL} ON contains(lower(d.text), lower(r.word))
), spans AS (
  SELECT doc_id, text, rule_idx, category, ref, len(word) AS n, CAST(list_sum([len(x) for x in p[1:i]]) + (i - 1) * len(word) AS INT) AS s
  FROM (SELECT *, unnest(range(1, len(p))) AS i FROM parts)
), hits AS (
  SELECT doc_id, text, rule_idx, substr(text, s + 1, n) AS word, category, s AS "start", CAST(s + n AS INT) AS "end", ref AS regulation_ref
  FROM spans QUALIFY row_number() OVER (PARTITION BY doc_id, s, n ORDER BY rule_idx) = 1
)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback: word and violation from the property k, action from the type."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type").isin("purchase", "signup"), "confirm").when(F.col("event_type") == "error", "dismiss").when(F.col("event_type") == "click", "modify").otherwise("other")
    word = F.get_json_object("props", "$.k")
    # words below 20 have one-sided feedback
    sided = F.when(word.cast("int") < 10, "dismiss").when(word.cast("int") < 20, "confirm").otherwise(action)
    return e.select("event_id", "ts", word.alias("word"), F.concat(F.lit("v-"), word).alias("violation_id"), F.when(F.col("event_id") % 7 == 0, action).otherwise(sided).alias("action"))


FEEDBACK_SQL = """
feedback AS (
  SELECT event_id, ts, word, 'v-' || word AS violation_id,
         CASE WHEN event_id % 7 <> 0 AND CAST(word AS INT) < 10 THEN 'dismiss' WHEN event_id % 7 <> 0 AND CAST(word AS INT) < 20 THEN 'confirm' ELSE a END AS action
  FROM (SELECT *, json_extract_string(props, '$.k') AS word,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'confirm' WHEN event_type = 'error' THEN 'dismiss' WHEN event_type = 'click' THEN 'modify' ELSE 'other' END AS a
        FROM events)
)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored reviews; violations as a JSON text of up to two entries."""
    o = table(spark, sf_dir, "orders")
    n = (F.col("o_orderkey") % 3).cast("int")
    sev = F.array(*map(F.lit, ["high", "medium", "low", "odd"]))[(F.col("o_orderkey") % 4).cast("int")]
    one = F.struct(F.col("o_orderstatus").alias("text"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("category"), sev.alias("severity"))
    two = F.struct(F.lit("x").alias("text"), F.lit("c").alias("category"), F.when(F.col("o_orderkey") % 2 == 0, "low").alias("severity"))
    return o.select(
        F.concat(F.lit("CR-"), F.col("o_orderkey").cast("string")).alias("review_id"), F.repeat(F.concat("o_orderpriority", F.lit(" ")), 12).alias("text"), F.col("o_orderstatus").alias("status"),
        F.array(*map(F.lit, ["pass", "low", "high"]))[n].alias("overall_risk"), n.alias("violation_count"),
        F.to_json(F.slice(F.array(one, two), F.lit(1), F.greatest(n, F.lit(1)))).alias("violations"), F.col("o_orderdate").alias("created_at"),
    )


REVIEWS_SQL = """
reviews AS (
  SELECT 'CR-' || o_orderkey AS review_id, repeat(o_orderpriority || ' ', 12) AS text, o_orderstatus AS status,
         ['pass', 'low', 'high'][1 + o_orderkey % 3] AS overall_risk, CAST(o_orderkey % 3 AS INT) AS violation_count, o_orderkey AS k, o_orderpriority AS p, o_orderdate AS created_at
  FROM orders
), violations AS (
  SELECT CASE WHEN k % 5 > 0 THEN p END AS category, ['high', 'medium', 'low', 'odd'][1 + k % 4] AS severity FROM reviews WHERE violation_count > 0
  UNION ALL SELECT 'c', CASE WHEN k % 2 = 0 THEN 'low' END FROM reviews WHERE violation_count = 2
)"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as memories; times are epoch seconds."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("m"), k.cast("string")).alias("key"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("value"),
        F.array(*map(F.lit, ["user", "auto", "lesson", "session", ""]))[(k % 5).cast("int")].alias("source"), F.array(*map(F.lit, ["long", "profile", "archived", "", "error"]))[(k % 7 % 5).cast("int")].alias("importance"),
        F.when(k % 4 > 0, (k % 10) / 10.0).alias("confidence"), F.when(k % 3 > 0, (k % 9 * 10).cast("double")).alias("stability"),
        F.when(k % 6 > 0, F.lit(NOW) - k * 7200).alias("last_review"), (F.lit(NOW) - k * 9000).alias("created_at"), (F.lit(NOW) - k * 5000).alias("updated_at"),
    )


MEMORIES_SQL = f"""
memories AS (
  SELECT 'm' || c_custkey AS key, c_name || ' ' || c_mktsegment AS value, ['user', 'auto', 'lesson', 'session', ''][1 + c_custkey % 5] AS source,
         ['long', 'profile', 'archived', '', 'error'][1 + c_custkey % 7 % 5] AS importance, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 10 AS DOUBLE) / 10 END AS confidence,
         CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 9 * 10 AS DOUBLE) END AS stability, CASE WHEN c_custkey % 6 > 0 THEN {NOW} - c_custkey * 7200 END AS last_review,
         {NOW} - c_custkey * 9000 AS created_at, {NOW} - c_custkey * 5000 AS updated_at
  FROM customer
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")


#: The vectors in double; ``dot`` is the sum of products.
VECTORS_SQL = "v AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation leads to the next; every third also to the one after it."""
    c = table(spark, sf_dir, "conversations")
    name = lambda n: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") + n).cast("string"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = c.join(last, "conv_id").withColumn("step", F.explode(F.array(F.lit(1), F.lit(2)))).filter((F.col("turn") + F.col("step") <= F.col("last")) & ((F.col("step") == 1) | (F.col("turn") % 3 == 0)))
    kinds = F.array(*map(F.lit, ["caused_by", "contradicts", "refines", "odd"]))
    to = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") + F.col("step")).cast("string"))
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn") * 10 + F.col("step")).alias("id"), name(0).alias("from_id"), to.alias("to_id"),
        kinds[((F.col("conv_id") + F.col("turn")) % 4).cast("int")].alias("link_type"), ((F.col("turn") % 5) / 5.0).alias("strength"), (F.col("conv_id") * 100 + F.col("turn")).alias("created_at"),
    )


LINKS_SQL = """
links AS (
  SELECT conv_id * 1000 + turn * 10 + step AS id, 'c' || conv_id || '-' || turn AS from_id, 'c' || conv_id || '-' || (turn + step) AS to_id,
         ['caused_by', 'contradicts', 'refines', 'odd'][1 + (conv_id + turn) % 4] AS link_type, CAST(turn % 5 AS DOUBLE) / 5 AS strength, conv_id * 100 + turn AS created_at
  FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) c, (VALUES (1), (2)) s(step)
  WHERE turn + step <= last AND (step = 1 OR turn % 3 = 0)
), turns AS (
  SELECT 'c' || conv_id || '-' || turn AS key, text AS value, role AS source FROM conversations
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("key"), F.col("text").alias("value"), F.col("role").alias("source"))
