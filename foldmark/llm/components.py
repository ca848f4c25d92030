"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import functions as F

from .common import stored


def _lowest(pairs):
    """Each node with the lowest of itself and its neighbours ``v``; hot nodes are summed up map-side first."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))


def _large_star(links):
    """Link every larger neighbour of a node to the lowest node next to it."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.where("v > u").join(_lowest(both), "u")
            .select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct())


def _small_star(links):
    """Link a node and its smaller neighbours to the lowest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    return (down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct())


def _is_star(links):
    """Whether every node has one link down to a root, and no root has one."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where(
        "down > 1 OR (down = 1 AND up > 0)").isEmpty()


def components(links):
    """(node, root) for every node of ``links`` (u, v) but the roots; root is the lowest node it reaches.

    A round's links are written to the shared folder; rounds end when the links are stars around
    their lowest nodes, after about log2 of the longest chain.
    """
    links = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                   "links")
    while not _is_star(links):
        links = stored(_small_star(_large_star(links)), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
