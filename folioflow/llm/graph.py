"""Connected components of a table of links, by alternating large and small stars.

Each round is a few joins and grouped minima over the links, written to the shared folder; nothing goes to
the driver but whether all links are stars. Minima are combined before the shuffle and written before they are
joined, so that Spark can split a node with very many links. The tables of a round are deleted after the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow import scratch


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)`` for each linked node but the least of its component."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    last = scratch.Room(links.sparkSession)
    edges = last.stage(edges, "links")
    while not _are_stars(edges):
        room = scratch.Room(links.sparkSession)
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = room.stage(both.groupBy("n").agg(F.min("m").alias("lo")).select("n", F.least("n", "lo").alias("lo")), "least")
        large = room.stage(both.filter("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("lo").alias("v")).distinct(), "large")
        least = room.stage(large.groupBy("u").agg(F.min("v").alias("lo")), "least")
        small = large.join(least, "u").filter("v > lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
        after = scratch.Room(links.sparkSession)
        edges = after.stage(small.unionByName(least.select("u", F.col("lo").alias("v"))).distinct(), "links")
        room.clear()
        last.clear()
        last = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _are_stars(edges: DataFrame) -> bool:
    """No node has two links down, and none that others link down to has one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.filter("down > 1 OR down = 1 AND up = 1").limit(1).count() == 0
