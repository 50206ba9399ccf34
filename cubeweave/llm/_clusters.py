"""Classes from candidate buckets: pivots, verified links and distributed union-find.

DataFrame functions only; what verifies pairs is the caller's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.llm._scratch import discard, materialise, resting_on


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    return tuple(row)


def components(edges: DataFrame, label: str) -> DataFrame:
    """Union-find by large and small stars: per node of ``edges`` (u, v), the least node that it is connected to.

    A large star links every greater neighbour of a node to the least of its
    neighbourhood; a small star links the node and its lesser neighbours to the
    least of these.  Repeated until nothing changes, all edges lead to the least
    node of their component.  Each step is a partial aggregation and a join whose
    hot keys Spark can split; no step holds a component in one place.
    """
    edges = materialise(edges.select("u", "v").where("u <> v").distinct(), f"{label}-edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("low")).select("k", F.least("k", "low").alias("low"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        large = materialise(large, f"{label}-large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("low"))
        small = down.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("low").alias("v")))
        before, edges = edges, materialise(small.where("u <> v").distinct(), f"{label}-small")
        discard(before, large)
        now = _fingerprint(edges)
        if now == mark:
            break
        mark = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    return resting_on(out, edges)


def classes(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame], label: str, candidates: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Components of the verified links among nodes that share a bucket.

    ``buckets`` holds (key, node), repeats allowed.  ``verify`` takes distinct pairs (u, v)
    and returns those that are links.  ``candidates``, if given, first gets the
    distinct nodes of all buckets of two nodes or more.  Returns (node, comp), for
    nodes that have a link.

    All pairs of a bucket count, without making them all.  First each bucket's
    nodes are tested against one pivot: the node with the most company in all its
    buckets, which tends to be what the others are copies of.  Pairs inside one
    component need no test, so only buckets whose other nodes are of several
    components go on: ``finish`` gets their (key, node, comp) and returns links
    (u, v) that make all remaining components.  What the three return or keep has
    to be materialised, as the passes that they are given are deleted after use.
    """
    # Dealt out once: the count, which reads both columns too, and the join share this shuffle.
    spread = buckets.repartition("key")
    sizes = spread.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("k", "n")
    members = materialise(spread.join(sizes.hint("shuffle_hash"), F.col("key") == F.col("k")).select("key", "node", "n").distinct(), f"{label}-members")
    company = members.groupBy(F.col("node").alias("c_node")).agg(F.sum("n").alias("company"))
    if candidates is not None:
        candidates(members.select("node").distinct())
    ranked = members.join(company, F.col("node") == F.col("c_node")).select("key", "node", "company")
    pivots = ranked.groupBy(F.col("key").alias("p_key")).agg(F.max(F.struct("company", "node")).alias("p")).select("p_key", F.col("p.node").alias("pivot"))
    met = materialise(members.join(pivots, (F.col("key") == F.col("p_key")) & (F.col("node") != F.col("pivot"))).select("key", "node", "pivot"), f"{label}-met")
    discard(members)
    edges = verify(met.select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct())
    joined = components(edges, label)
    comp = materialise(joined, f"{label}-comp")
    discard(edges, joined)
    known = comp.select(F.col("node").alias("c_node"), "comp")
    # A pivot has met all of its bucket; what is left to test is among the others.
    others = met.select("key", "node")
    placed = others.join(known, F.col("node") == F.col("c_node"), "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    spread = placed.groupBy(F.col("key").alias("k")).agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("k")
    rest = materialise(placed.join(spread, F.col("key") == F.col("k")).select("key", "node", "comp"), f"{label}-open")
    discard(met)
    if rest.isEmpty():
        discard(rest)
        return comp
    more = finish(rest)
    joined = components(more.unionByName(comp.select(F.col("node").alias("u"), F.col("comp").alias("v"))), label)
    discard(rest, more, comp)
    comp = materialise(joined, f"{label}-comp")
    discard(joined)
    return comp
