"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored


def _star(edges: DataFrame, low: "F.Column") -> DataFrame:
    """Ties every higher neighbour of a node to the least of the node and its neighbours.

    The least comes from an aggregate that combines before the shuffle; the join back to the edges
    is one that adaptive execution can split, so a node with very many links is no hot task.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges.join(least, "a").where(low).select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(links: DataFrame, most: int = 60, held: list[str] | None = None) -> DataFrame:
    """links(a, b), in any direction -> (node, root): root is the least node that node reaches.

    Nodes without links do not appear. Self links, repeated links and nulls add nothing. The edges
    are written to the shared folder after every round, and the round before is deleted; the number
    of rounds grows with the logarithm of the longest path. ``held`` gets what the result reads.
    """
    older: list[str] = []
    held = [] if held is None else held
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = stored(edges, "edges", older), None
    for _ in range(most):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, F.col("b") > F.col("a")).where("a != b").distinct()
        # the small star also ties the node itself to its least neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        newer: list[str] = []
        edges = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges", newer)
        released(links.sparkSession, older)
        older = newer
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    held += older
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
