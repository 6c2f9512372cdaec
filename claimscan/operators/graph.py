"""Closure of causal links and walks over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscan.functions.work import stash


def transitive_closure(edges: DataFrame, max_iter: int = 64) -> DataFrame:
    """(ancestor, descendant, depth) of edges (from_id, to_id): all reachable pairs with their least depth, and each node to itself at 0.

    Path doubling: each round joins the paths that were new or shorter in the last round with all paths, on either side, so chains
    of length n take log2(n) rounds and nothing old is joined with old again. Every round is written, and the loop ends when a
    round finds nothing better. A cycle does not replace the rows at depth 0.
    """
    one = edges.select(F.col("from_id").alias("ancestor"), F.col("to_id").alias("descendant")).filter("ancestor != descendant").distinct()
    paths = fresh = stash(one.withColumn("depth", F.lit(1).cast("long")), "paths")
    pair = ["ancestor", "descendant"]

    def joined(first: DataFrame, second: DataFrame) -> DataFrame:
        on = second.select(F.col("ancestor").alias("via"), F.col("descendant").alias("end"), F.col("depth").alias("more"))
        return first.join(on, first["descendant"] == on["via"]).select("ancestor", F.col("end").alias("descendant"), (F.col("depth") + F.col("more")).alias("depth")).filter("ancestor != descendant")

    for _ in range(max_iter):
        longer = joined(fresh, paths) if fresh is paths else joined(fresh, paths).union(joined(paths, fresh))
        found = longer.groupBy(*pair).agg(F.min("depth").alias("depth")).join(paths.withColumnRenamed("depth", "known"), pair, "left")
        fresh = stash(found.filter(F.col("known").isNull() | (F.col("depth") < F.col("known"))).drop("known"), "fresh")
        if not fresh.limit(1).count():
            break
        paths = stash(paths.join(fresh, pair, "left_anti").union(fresh), "paths")
    nodes = edges.select(F.col("from_id").alias("n")).union(edges.select("to_id")).distinct()
    return paths.union(nodes.select("n", "n", F.lit(0).cast("long")))


PAIR = ["ancestor", "descendant"]


def _better(found: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """The pairs of ``found`` that ``known`` lacks or has at a greater depth, with their least depth, written."""
    least = found.groupBy(*PAIR).agg(F.min("depth").alias("depth")).join(known.withColumnRenamed("depth", "known"), PAIR, "left")
    return stash(least.filter(F.col("known").isNull() | (F.col("depth") < F.col("known"))).drop("known"), name)


def _replaced(paths: DataFrame, fresh: DataFrame) -> DataFrame:
    return stash(paths.join(fresh, PAIR, "left_anti").unionByName(fresh), "paths")


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("from_id", "to_id").filter("from_id != to_id").distinct()


def _selves(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("from_id").alias("n")).union(edges.select("to_id")).distinct()
    return nodes.select(F.col("n").alias("ancestor"), F.col("n").alias("descendant"), F.lit(0).cast("long").alias("depth"))


def add_edges(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """The closure after a batch of new ``edges`` (from_id, to_id); only pairs that a new edge connects are computed.

    Ancestors of an edge's start are joined with the edges, and these with the descendants of their ends as they were before. A path over several
    new edges takes a round for each, which starts from what the round before found better.
    """
    fresh_nodes = _selves(edges).join(closure.filter("depth = 0").select("ancestor"), "ancestor", "left_anti").select(*closure.columns)
    paths = stash(closure.unionByName(fresh_nodes), "paths")
    below = paths.select(F.col("ancestor").alias("to_id"), F.col("descendant").alias("end"), F.col("depth").alias("more"))
    over = stash(_distinct_edges(edges).join(below, "to_id").select(F.col("from_id").alias("via"), "end", (F.col("more") + 1).alias("more")), "over")
    fresh = paths
    while True:
        longer = fresh.join(over, fresh["descendant"] == over["via"]).select("ancestor", F.col("end").alias("descendant"), (F.col("depth") + F.col("more")).alias("depth"))
        fresh = _better(longer.filter("ancestor != descendant"), paths, "fresh")
        if not fresh.limit(1).count():
            return paths
        paths = _replaced(paths, fresh)


def remove_edges(closure: DataFrame, removed: DataFrame, left: DataFrame) -> DataFrame:
    """The closure after ``removed`` edges went; ``left`` are all edges that stay. Only pairs with a shortest path over a removed edge are derived again.

    Such a pair's depth is the sum of the depths to and from the edge. Each is first derived over one edge that stays and a pair that is not affected, then
    from what was found so, round by round, until nothing is shorter; a pair that is not found is gone. Nodes without an edge go too.
    """
    gone = _distinct_edges(removed).join(_distinct_edges(left), ["from_id", "to_id"], "left_anti")
    up = closure.select("ancestor", F.col("descendant").alias("from_id"), F.col("depth").alias("a"))
    down = closure.select(F.col("ancestor").alias("to_id"), "descendant", F.col("depth").alias("b"))
    over = up.join(gone, "from_id").join(down, "to_id").select(*PAIR, (F.col("a") + F.col("b") + 1).alias("depth"))
    affected = stash(closure.join(over.distinct(), [*PAIR, "depth"], "left_semi").filter("depth > 0").select(*PAIR), "affected")
    kept = stash(closure.filter("depth > 0").join(affected, PAIR, "left_anti"), "kept")
    selves = _selves(left)
    step = _distinct_edges(left).select(F.col("from_id").alias("ancestor"), F.col("to_id").alias("via"))
    found, base = None, kept.unionByName(selves)
    while True:
        ends = base.select(F.col("ancestor").alias("via"), "descendant", (F.col("depth") + 1).alias("depth"))
        reach = step.join(ends, "via").select(*PAIR, "depth").join(affected, PAIR, "left_semi")
        base = _better(reach, affected.limit(0).withColumn("depth", F.lit(0).cast("long")) if found is None else found, "fresh")
        if not base.limit(1).count():
            break
        found = base if found is None else _replaced(found, base)
    return kept.unionByName(selves) if found is None else kept.unionByName(selves).unionByName(found)


def causal_chain(keys: DataFrame, closure: DataFrame, links: DataFrame, memories: DataFrame, max_depth: int = 5) -> DataFrame:
    """Ancestors of each key within a depth, with the direct link's relation and strength, in either direction, and the memory's value."""
    up = closure.filter((F.col("depth") > 0) & (F.col("depth") <= max_depth)).join(keys.select(F.col("key").alias("descendant")), "descendant")
    l = links.select("from_id", "to_id", "relation", "strength")  # noqa: E741
    both = l.union(l.select("to_id", "from_id", "relation", "strength")).distinct().select(F.col("from_id").alias("ancestor"), F.col("to_id").alias("descendant"), "relation", "strength")
    m = memories.select(F.col("key").alias("ancestor"), "value", "source")
    out = up.join(both, ["ancestor", "descendant"], "left").join(m, "ancestor", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(F.col("descendant").alias("key"), "ancestor", "depth", text("relation"), "strength", text("value"), text("source"))


def neighbours(keys: DataFrame, links: DataFrame, link_type: str | None = None) -> DataFrame:
    """All links (id, from_id, to_id, link_type, ...) that touch a key at either end, once per key."""
    rows = links.filter(F.col("link_type") == link_type) if link_type else links
    k = keys.select("key").distinct()
    ends = [rows.join(k, rows[c] == k["key"]) for c in ("from_id", "to_id")]
    return ends[0].union(ends[1]).dropDuplicates(["key", "id"])
