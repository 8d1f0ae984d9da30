"""Connected components by alternating large-star and small-star steps.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.) Every
step is an aggregate (minimum neighbour) and an equi-join, so a hub vertex is
combined before the shuffle. Lineage is cut by checkpoint each round; rounds go
on until nothing changes, about the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # (u, v) with v > u is exactly an edge in its stored direction (v, u) flipped.
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return (
        up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.filter("u <> v").unionByName(own).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Each child has one parent and no parent is a child."""
    parents = edges.groupBy("u").agg(F.count("*").alias("n"))
    roots = edges.select(F.col("v").alias("u")).distinct()
    bad = parents.filter("n > 1").select("u").unionByName(
        roots.join(parents.select("u"), "u", "left_semi")
    )
    return bad.isEmpty()


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex; a component is named by its lowest id.

    ``vertices`` has ``id``; ``edges`` has ``a_id`` and ``b_id``. Isolated
    vertices are their own component.
    """
    # Stored as child u > parent v.
    star = edges.select(
        F.greatest("a_id", "b_id").alias("u"), F.least("a_id", "b_id").alias("v")
    ).filter("u <> v").distinct()
    star = cut_lineage(star)
    while not _is_star_forest(star):
        star = cut_lineage(_small_star(_large_star(star)))
    return vertices.select("id").join(
        star.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left"
    ).select("id", F.coalesce("component", "id").alias("component"))
