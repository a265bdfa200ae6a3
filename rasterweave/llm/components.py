"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node in a, b of edges.

    A round hooks the larger neighbours of each node onto its least neighbour
    (large star), then the smaller ones and the node itself (small star), until
    every component is a star.  Rounds grow with the square of the logarithm of
    the nodes at most, whatever a component's diameter, so they need no cap.  All
    minima are partial before they are shuffled, so a node with very many edges is
    no task's burden alone; the edges are written to the shared folder each round.
    """
    nodes = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).filter("node IS NOT NULL").distinct(), "cc-nodes")
    # a > b from here on.
    links = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    while True:
        least = links.select("a", "b").union(links.select("b", "a")).groupBy(F.col("a").alias("b")).agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = stored(links.join(least, "b").select("a", F.col("least").alias("b")).distinct(), "cc")
        discard(links)
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        links = stored(small.union(least.select("a", F.col("least").alias("b"))).distinct(), "cc")
        discard(large)
        # Stars: no node has two roots, and no root is hooked.
        twice = links.groupBy("a").count().filter("count > 1").select("a")
        if not twice.union(links.select("b").join(links.select(F.col("a").alias("b")), "b", "left_semi")).limit(1).count():
            return nodes.join(links.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("label"))
