"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfold.session import cut, discard


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """One step: every node links its neighbours (with ``both`` the larger ones, else the smaller) to its least neighbour.

    The least neighbour is a plain minimum, combined before the shuffle, and is joined back to the edges: the
    neighbours of a hub are never gathered, and a skewed join splits its edges.
    """
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if both:
        return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    linked = edges.join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node with an edge to another one.

    ``edges``: a, b (bigint). Null ends and loops are left out, repeated edges count once. Each round is written to the
    shared folder, and the one before deleted; a graph of n nodes needs about log(n) of them.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).alias("_ok"))
    edges = cut(edges.where("_ok").drop("_ok").distinct())
    before = None
    for _ in range(most_rounds):
        # two sums of the edges tell whether the round changed any
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
        last, edges = edges, cut(_stars(_stars(edges, True), False))
        discard(last)
    raise RuntimeError(f"components not found in {most_rounds} rounds")
