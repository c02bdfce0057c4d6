"""Connected components of links between integer nodes, by alternating star contractions.

Every step is a shuffled join or aggregation over the links; the links never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm._shared import materialize


def _star(edges: DataFrame, tag: str) -> DataFrame:
    """Edges (u, v) joined with the least of u and its v. The minima are written, so that a hub's rows can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("v_min"))
    least = materialize(least.select("u", F.least("u", "v_min").alias("root")), tag)
    return edges.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node of its component. Self-links count for nothing.

    Large stars hang each larger neighbour on a node's least neighbour; small stars do so with the smaller ones.
    Both keep components together, and end when each component is one star.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "cc-links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "cc-large").filter("v > u").select(F.col("v").alias("u"), F.col("root").alias("v")).distinct()
        large = materialize(large, "cc-large-edges")
        stars = _star(large, "cc-small")
        hung = stars.filter("v <> root").select(F.col("v").alias("u"), F.col("root").alias("v"))
        small = materialize(hung.unionByName(stars.select("u", F.col("root").alias("v"))).distinct(), "cc-edges")
        if edges.exceptAll(small).isEmpty() and small.exceptAll(edges).isEmpty():
            break
        edges = small
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
