"""Connected components of an edge table, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

#: A node with more neighbours than HUB gets its minimum by a broadcast table, of the MAX_HUBS largest at most; the others by a join.
HUB, MAX_HUBS = 2_000, 100_000
#: Neighbours of a node, up to which one task may hold them all.
PLAIN = 100_000


def _with_least(rows: DataFrame, node: str, own: bool) -> DataFrame:
    """Adds `low` to rows (node, other): the least other of the node, or the node itself if `own` and less.

    The rows of a hub meet its minimum where they are; only those of other
    nodes are shuffled for it, so no task gets all edges of a hub.
    """
    other = next(c for c in rows.columns if c != node)
    low = F.least(F.col(node), F.col("_low")) if own else F.col("_low")
    least = rows.groupBy(node).agg(F.min(other).alias("_low"), F.count("*").alias("_n"))
    hubs = least.filter(F.col("_n") > HUB).orderBy(F.desc("_n"), node).limit(MAX_HUBS).select(node, low.alias("low"))
    seen = rows.join(F.broadcast(hubs), node, "left")
    plain = seen.filter("low IS NULL").drop("low").join(least.select(node, low.alias("low")), node)
    return seen.filter("low IS NOT NULL").unionByName(plain)


def _least_of_few(rows: DataFrame, node: str, own: bool) -> DataFrame:
    """`_with_least` where no node has more than PLAIN others: one shuffle, by node."""
    other = next(c for c in rows.columns if c != node)
    low = F.min(other).over(W.partitionBy(node))
    return rows.withColumn("low", F.least(F.col(node), low) if own else low)


def _pair(a: str, b: str, *names: str) -> Column:
    return F.struct(F.col(a).alias(names[0]), F.col(b).alias(names[1]))


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) that has an edge to another: root is the least node that it reaches.

    Alternating rounds.  In the first, every node links its larger neighbours to
    the least of its neighbourhood; in the second, its smaller ones.  Each keeps
    as many rows as edges, whatever the degrees, and is cut at the shared
    folder; where there are hubs so is its first half, as each half names its
    rows several times and the driver holds a plan of every use.  Stops at the
    fixed point, where every node points at its root.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v <> m").distinct())
    state = _state(now)
    while state[0]:
        plain = state[2] <= PLAIN
        least = _least_of_few if plain else _with_least
        both = now.select(F.inline(F.array(_pair("v", "m", "u", "w"), _pair("m", "v", "u", "w"))))
        large = least(both, "u", True).filter("w > u").select(F.col("w").alias("v"), F.col("low").alias("m")).filter("v <> m")
        small = least(large if plain else cut(large.distinct()), "v", False)
        ends = small.select(F.inline(F.array(_pair("v", "low", "v", "m"), _pair("m", "low", "v", "m"))))
        now = cut(ends.filter("v <> m").distinct())
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("v").alias("node"), F.col("m").alias("root")).union(now.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """How many edges there are, a digest of them, and the most neighbours of a node."""
    end = lambda node, digest, n: F.struct(F.col(node).alias("u"), digest.alias("h"), F.lit(n).alias("n"))
    ends = edges.select(F.inline(F.array(end("v", F.xxhash64("v", "m"), 1), end("m", F.lit(0).cast("long"), 0))))
    each = ends.groupBy("u").agg(F.count("*").alias("near"), F.sum("n").alias("n"), F.bit_xor("h").alias("h"))
    return tuple(each.agg(F.sum("n"), F.bit_xor("h"), F.max("near")).first())
