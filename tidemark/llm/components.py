"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import written


def _directed(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = _directed(links)
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them; links run from large to small."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    lower = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (a, b): the least node reachable.

    Rounds of one large and one small star halve the height of the trees; the
    links are written after each round and no node gathers its neighbours, whose
    minimum is combined before it is moved.  It ends when all links lead from a
    node to the least one of its component.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = written(
        links.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "links"
    )
    while True:
        starred = _large_star(now).distinct()
        following = written(_small_star(starred).distinct(), "links")
        # stars: each node has one link, and nothing is linked to a node that has one
        heads = following.select(F.col("a").alias("head"), F.lit(1).alias("inner"))
        state = (
            following.groupBy("a")
            .agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
            .join(heads.distinct(), F.col("b") == F.col("head"), "left")
            .agg(F.max("n").alias("n"), F.max("inner").alias("inner"))
            .first()
        )
        if (state["n"] or 1) == 1 and state["inner"] is None:
            break
        now = following
    nodes = following.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(following.select("b", "b").distinct())
