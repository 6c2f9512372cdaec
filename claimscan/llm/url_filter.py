"""URL filters in time: dated list entries become validity intervals, and an as-of join evaluates every
capture against the entries that were active when it was fetched.

An entry adds or removes a value (a URL, a path prefix, a host or a domain) to or from a list at a time. The
changes of a value, in order, give disjoint intervals in which it is on the list. A capture asks for its
URL, all its path prefixes, its host and all the domains above it; an equi-join on kind and value with
the interval as a range condition finds at most one interval a list for each. The most specific match
decides (URL, longer prefix, host, longer domain), and a block outweighs an allowance of equal rank.

Skew: a host may have a third of all captures. Up to BROADCAST_ENTRIES intervals are broadcast, so nothing
is dealt by host; beyond that, intervals are copied to SALTS parts and captures are spread over them.

Cases: a null or malformed URL has no host and matches nothing, nor does a capture without time; equal
captures are joined once and get the same verdict; of changes at one time a removal comes last; entries
without list, kind, value or time are ignored; an empty table gives an empty result, an empty list
"allowed". Further columns of the captures are kept, except such that bear the name of a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._work import small_side, stash

KINDS = {"domain": 0, "host": 1, "prefix": 2, "url": 3}
BROADCAST_ENTRIES = 200_000
SALTS = 32
RESULTS = ["host", "verdict", "rule_kind", "rule_value", "n_active"]


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.rtrim(F.lower(found), F.lit("."))


def path_of(url: Column) -> Column:
    """What follows the authority, without the fragment; at least a slash."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*|#.*$", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def keys(url: Column, deepest: int = (1 << 31) - 1) -> Column:
    """All (kind, value) that a list may have for the URL; prefixes and domains of at most ``deepest`` parts only."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - deepest + 1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    parts = F.split(F.substring_index(path, "?", 1), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(deepest))), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.array_join(F.slice(parts, 1, i), "/")).alias("value")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")), F.struct(F.lit("url").alias("kind"), F.concat(host, path).alias("value")))
    return F.when(host != "", F.array_distinct(F.concat(own, domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, kind, value, since, until) from entries (list, verdict, kind, value, change, at).

    ``change`` is add or remove; ``until`` is exclusive, and null while the value is on the list.
    """
    known = entries.select("list", "verdict", "kind", "value", "change", "at").dropna(subset=["list", "kind", "value", "change", "at"])
    w = W.partitionBy("list", "kind", "value").orderBy("at", "change")
    turns = known.withColumn("was", F.lag("change").over(w)).filter((F.col("was") != F.col("change")) | (F.col("was").isNull() & (F.col("change") == "add")))
    spans = turns.withColumn("until", F.lead("at").over(w)).filter("change = 'add'")
    return spans.filter("until IS NULL OR until > at").select("list", "verdict", "kind", "value", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """Adds ``host``, ``verdict`` (blocked or allowed), the deciding ``rule_kind`` and ``rule_value``, and ``n_active``."""
    captures = captures.drop(*RESULTS)
    spans = stash(intervals(entries), "intervals")
    asked = captures.select(F.col(url).alias("u"), F.col(at).alias("t")).dropna().distinct()
    parts = F.max(F.size(F.split("value", "[/.]")))  # at least the parts of any listed prefix or domain
    deepest = spans.filter("kind IN ('prefix', 'domain')").agg(parts).first()[0] or 1
    asked = asked.select("u", "t", F.explode(keys(F.col("u"), deepest)).alias("k")).select("u", "t", "k.kind", "k.value")
    side = small_side(spans, BROADCAST_ENTRIES)
    if side is spans:
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("u", "t"), F.lit(SALTS)))
        side = spans.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    on = ["kind", "value"] + ["salt"] * (side is not spans and "salt" in side.columns)
    active = asked.join(side, on).filter((F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until"))))
    rank = F.struct(
        F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("kind")].alias("kind_rank"),
        F.length("value").alias("size"),
        (F.col("verdict") == "blocked").alias("blocks"),
        "kind",
        "value",
        "verdict",
    )
    best = active.groupBy("u", "t").agg(F.max(rank).alias("best"), F.count("*").alias("n_active"))
    joined = captures.join(best, (captures[url] == best["u"]) & (captures[at] == best["t"]), "left")
    return joined.select(
        *[captures[c] for c in captures.columns],
        host_of(captures[url]).alias("host"),
        F.coalesce("best.verdict", F.lit("allowed")).alias("verdict"),
        F.col("best.kind").alias("rule_kind"),
        F.col("best.value").alias("rule_value"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
    )


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries derived from the pages themselves, as the tables have no lists: a part of the hosts is
    blocked for 90 days and some of them again later, a part has an allowed directory, each domain is
    blocked for 30 days, and every 97th page's URL is blocked from day 50 on. Times are days from 0 on.
    """
    host = host_of(F.col("url"))
    hosts = pages.select(host.alias("h")).filter("h != ''").distinct().withColumn("x", F.conv(F.substring(F.md5("h"), 1, 4), 16, 10).cast("long"))
    row = lambda df, name, verdict, kind, value, change, at: df.select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(change).alias("change"), at.cast("long").alias("at"))
    x, h = F.col("x"), F.col("h")
    domains = hosts.select(F.substring_index("h", ".", -2).alias("h")).distinct().withColumn("x", F.conv(F.substring(F.md5("h"), 1, 4), 16, 10).cast("long"))
    parts = [
        row(hosts.filter(x % 3 == 0), "hosts", "blocked", "host", h, "add", x % 200),
        row(hosts.filter(x % 3 == 0), "hosts", "blocked", "host", h, "remove", x % 200 + 90),
        row(hosts.filter(x % 15 == 0), "hosts", "blocked", "host", h, "add", x % 200 + 150),
        row(hosts.filter(x % 7 == 0), "directories", "allowed", "prefix", F.concat(h, F.lit("/en")), "add", x % 100),
        row(domains, "domains", "blocked", "domain", h, "add", x % 366),
        row(domains, "domains", "blocked", "domain", h, "remove", x % 366 + 30),
        row(pages.filter("page_id % 97 = 0").filter(host != ""), "urls", "blocked", "url", F.concat(host, path_of(F.col("url"))), "add", F.lit(50)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day that its id gives, against the entries derived from all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.select("page_id", "url", F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("long").alias("fetched_at"))
    return evaluate(captures, derived_entries(pages)).select("page_id", "url", F.col("fetched_at").alias("fetched_day"), *RESULTS)


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, url, CAST((page_id * 7919) % 366 AS BIGINT) AS t,
         rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS host,
         regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*|#.*$', '', 'g') AS r
  FROM pages
), c AS (
  SELECT *, CASE WHEN starts_with(r, '/') THEN r ELSE '/' || r END AS path FROM p
), hosts AS (
  SELECT h, CAST('0x' || substr(md5(h), 1, 4) AS BIGINT) AS x FROM (SELECT DISTINCT host AS h FROM c WHERE host <> '')
), domains AS (
  SELECT h, CAST('0x' || substr(md5(h), 1, 4) AS BIGINT) AS x FROM (SELECT DISTINCT array_to_string(string_split(h, '.')[-2:], '.') AS h FROM hosts)
), entries AS (
  SELECT 'hosts' AS list, 'blocked' AS verdict, 'host' AS kind, h AS value, 'add' AS change, x % 200 AS day FROM hosts WHERE x % 3 = 0
  UNION ALL SELECT 'hosts', 'blocked', 'host', h, 'remove', x % 200 + 90 FROM hosts WHERE x % 3 = 0
  UNION ALL SELECT 'hosts', 'blocked', 'host', h, 'add', x % 200 + 150 FROM hosts WHERE x % 15 = 0
  UNION ALL SELECT 'directories', 'allowed', 'prefix', h || '/en', 'add', x % 100 FROM hosts WHERE x % 7 = 0
  UNION ALL SELECT 'domains', 'blocked', 'domain', h, 'add', x % 366 FROM domains
  UNION ALL SELECT 'domains', 'blocked', 'domain', h, 'remove', x % 366 + 30 FROM domains
  UNION ALL SELECT 'urls', 'blocked', 'url', host || path, 'add', 50 FROM c WHERE page_id % 97 = 0 AND host <> ''
), turns AS (
  SELECT * FROM (SELECT *, lag(change) OVER w AS was FROM entries WINDOW w AS (PARTITION BY list, kind, value ORDER BY day, change))
  WHERE was <> change OR (was IS NULL AND change = 'add')
), spans AS (
  SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, kind, value ORDER BY day, change) AS until FROM turns)
  WHERE change = 'add' AND (until IS NULL OR until > day)
), asked AS (
  SELECT DISTINCT url, t, 'host' AS kind, host AS value FROM c WHERE host <> ''
  UNION SELECT url, t, 'url', host || path FROM c WHERE host <> ''
  UNION SELECT url, t, 'domain', array_to_string(string_split(host, '.')[i:], '.')
        FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host <> '')
  UNION SELECT url, t, 'prefix', host || array_to_string(string_split(string_split(path, '?')[1], '/')[1:i], '/')
        FROM (SELECT *, unnest(range(1, len(string_split(string_split(path, '?')[1], '/')) + 1)) AS i FROM c WHERE host <> '')
), active AS (
  SELECT a.url, a.t, a.kind, a.value, s.verdict,
         row_number() OVER (PARTITION BY a.url, a.t ORDER BY CASE a.kind WHEN 'domain' THEN 0 WHEN 'host' THEN 1 WHEN 'prefix' THEN 2 ELSE 3 END DESC,
                            length(a.value) DESC, (s.verdict = 'blocked') DESC, a.kind DESC, a.value DESC) AS rn,
         count(*) OVER (PARTITION BY a.url, a.t) AS n
  FROM asked a JOIN spans s ON s.kind = a.kind AND s.value = a.value AND a.t >= s.day AND (s.until IS NULL OR a.t < s.until)
)
SELECT c.page_id, c.url, c.t AS fetched_day, c.host, coalesce(v.verdict, 'allowed') AS verdict, v.kind AS rule_kind, v.value AS rule_value,
       coalesce(v.n, 0) AS n_active
FROM c LEFT JOIN active v ON v.url = c.url AND v.t = c.t AND v.rn = 1
"""
