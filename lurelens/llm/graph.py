"""Connected components by alternating large and small stars; nothing is collected but one change count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """arcs (u, v): for each u the least m of itself and its neighbours; the neighbours that lie beyond u (large)
    or not beyond u (small) are linked to m."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = arcs.join(least.hint("merge"), "u")  # a hot u is split by the join; the driver gathers nothing
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); the component is its least node.

    Nulls and loops are left out; edges may repeat and point either way.  An empty table gives an empty table.
    Each round is written in the shared folder; the rounds grow with the logarithm of the longest path.
    """
    arcs = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    arcs = keep(arcs, "arcs")

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    was = mark(arcs)
    while was[0]:
        both = arcs.union(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = keep(_star(both, True), "arcs")
        discard(arcs)
        arcs = keep(_star(large, False), "arcs")
        discard(large)
        now = mark(arcs)
        if now == was:
            break
        was = now
    roots = arcs.select("v").distinct()
    return arcs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", F.col("v").alias("component")))
