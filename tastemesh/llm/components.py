"""Connected components of a table of links, by repeated joins; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemesh.sources.staging import stage


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reached) for all nodes of ``links`` (``a``, ``b``).

    Each round hangs every node's larger neighbours below the smallest node around it (large star), then every node
    and its smaller neighbours below the smallest of them (small star); trees flatten in a logarithmic number of
    rounds. A node's neighbours are only ever reduced to a minimum, never gathered.
    """
    edges = _downward(links.select("a", "b"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _downward(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(_downward(small.unionByName(floor.select("a", F.col("m").alias("b")))), "links")
        # Done when each node hangs below one other, and that one below none.
        parents, children = edges.select(F.col("b").alias("a")), edges.groupBy("a").agg(F.count("*").alias("n"))
        if children.where("n > 1").isEmpty() and children.join(parents, "a", "left_semi").isEmpty():
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
