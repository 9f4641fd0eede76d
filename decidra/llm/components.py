"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decidra.llm.common import cut


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of edges(a, b). Nodes without an edge have no row.

    Every round hangs the larger neighbours of each node on the smallest node around it, then the smaller ones, until
    every node hangs on one that hangs on none: a number of rounds that grows with the logarithm of the longest path.
    Each round is written, so a lost executor repeats one round at most."""
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    while True:
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.select("a", F.col("m").alias("b"))).filter("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("m", F.explode(F.array("a", "b")).alias("a"))
        links = cut(small.select("a", F.col("m").alias("b")).filter("a <> b").distinct(), name)
        count = links.agg(F.count("*").alias("n"), F.count_distinct("a").alias("k")).first()
        if count["n"] == count["k"] and links.join(links.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
