"""Connected components of a written edge table by contraction; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieweave.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); the root is one of the component's nodes.

    Each round points every node at its smallest neighbour, follows the pointers to their ends
    and contracts the edges to those.  A component loses at least half of its nodes in a round,
    and following doubles its reach each time, so rounds grow with the logarithm of the size.
    Nulls and loops are left out.  Each step is a written table.
    """
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        parents = materialize(nearest.select("node", F.least("node", "b").alias("root")), "parents")
        while True:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = materialize(parents.join(above, "root").select("node", "root", "next"), "parents")
            parents = moved.select("node", F.col("next").alias("root"))
            if moved.where("root <> next").isEmpty():
                break
        if found is None:
            found = parents
        else:
            higher = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = materialize(
                found.join(higher, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "found"
            )
        ends_a = parents.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        ends_b = parents.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        left = edges.join(ends_a, "a").join(ends_b, "b").where("root_a <> root_b")
        edges = materialize(
            left.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "edges"
        )
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
