"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.plans.storage import discard, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """``(id, component)`` for every node of an undirected edge table; a component is named by its smallest id.

    Each round hooks every node to its smallest neighbour, shortens the chains by pointer
    jumping and contracts the edges, so chains shrink by a power of two a round. Neighbours
    are only ever reduced by ``min``, which combines before the shuffle: a hub costs one row
    a task. Edges with a null end are dropped; a self loop makes a component of one.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    live, before = pairs.filter("a < b"), None
    for _ in range(max_rounds):
        parent = written(live.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("p")))
        if parent.isEmpty():
            return labels
        hop = parent.select(F.col("id").alias("p"), F.col("p").alias("p1"))
        hop2 = parent.select(F.col("id").alias("p1"), F.col("p").alias("p2"))
        jumped = written(parent.join(hop, "p", "left").join(hop2, "p1", "left").select("id", F.coalesce("p2", "p1", "p").alias("p")))
        up = jumped.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        down = jumped.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        moved = live.join(up, "a", "left").join(down, "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).filter("x <> y")
        live = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(parent, *([before] if before is not None else []))
        before = live
        labels = labels.join(jumped.select(F.col("id").alias("component"), F.col("p").alias("__p")), "component", "left").select("id", F.coalesce("__p", "component").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
