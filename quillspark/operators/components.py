"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialize

EDGES_PER_PARTITION = 500_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v). Large: larger neighbours of u go to the least of u and its neighbours. Small: the smaller ones and u itself do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    moved = joined.where("v > u" if large else "v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(node, component): the least node reachable, for each node of at least one edge between different nodes.

    The edge list only ever shrinks towards one star for each component; every round is cut off by
    a checkpoint, in as many partitions as the edges fill. Null ends and loops are ignored.
    """
    edges = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct())
    parts = max(1, -(-edges.count() // EDGES_PER_PARTITION))
    mark = None
    for _ in range(max_rounds):
        edges = materialize(_star(materialize(_star(edges, True).coalesce(parts)), False).coalesce(parts))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = now
    raise RuntimeError(f"components still changed after {max_rounds} rounds")
