"""Connected components of a distributed list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that it reaches) of every node that has a link.

    A round replaces each node's links by links to its smallest neighbour: first those to larger
    nodes, then those to smaller ones. Minima are partial aggregates joined back to the links, so a
    node with very many links is no task's load; rounds grow with the logarithm of a chain's length.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, before = stash(edges, "links"), None
    while True:
        edges = _small_star(_large_star(edges))
        edges = stash(edges, "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    to = both.filter("v > u").join(low, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    to = edges.join(low.select(F.col("u").alias("of"), "m"), F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
