"""Connected components over an edge table, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolot.runtime import materialize


def _minimum_of_neighbours(edges: DataFrame) -> DataFrame:
    """(u, m) with the least of u and all its neighbours; partial aggregation keeps hubs cheap."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    return both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Label every vertex of `edges(a, b)` with the least vertex that it reaches.

    Alternates two steps until nothing changes: every vertex links its larger neighbours to its
    least neighbour, then every vertex links its smaller neighbours to the least of them. Each
    round is two aggregations and two equi-joins, written to the shared folder so that plans stay
    short. The number of rounds grows with the logarithm of the largest component.

    Self-loops are kept as single vertices, repeated edges are merged, nulls are dropped; an empty
    table gives an empty result. Returns (vertex, component).
    """
    kept = edges.where("a IS NOT NULL AND b IS NOT NULL")
    loops = kept.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    links = materialize(
        kept.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    vertices = materialize(loops, "vertices")
    for _ in range(max_rounds):
        low = _minimum_of_neighbours(links)
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        small = materialize(small, "links")
        changed = not (small.exceptAll(links).isEmpty() and links.exceptAll(small).isEmpty())
        links = small
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = links.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("component"))
    return vertices.join(roots, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
