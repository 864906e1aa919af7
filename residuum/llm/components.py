"""Connected components of an edge relation by contraction, each round a few joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from residuum.session import stage


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of any ordered type; returns (node, root), root being the smallest node of the component.

    Every node points to its smallest neighbour, pointers are followed once more, and edges are
    rewritten to where their ends point. The smallest node of a component always points to itself, so it
    is what remains. Paths shrink by a constant factor a round, so rounds grow with the logarithm of the
    longest path. Minima combine before the shuffle, so a node with many edges costs one row a task.
    Nodes without an edge do not appear; loops and repeated edges change nothing; no edges give no rows.
    """
    live = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("other")))
        near = ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root"))
        further = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = stage(near.join(further, "root").select("node", F.col("next").alias("root")))
        rounds.append(moved)
        a, b = moved.select(F.col("node").alias("a"), F.col("root").alias("ra")), moved.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = stage(live.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0]
    for later in rounds[1:]:
        out = out.join(later.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
