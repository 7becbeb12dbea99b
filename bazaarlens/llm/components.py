"""Connected components of an undirected graph as alternating star joins.

Each round joins every node with the smallest node of its neighbourhood, first for larger
neighbours, then for smaller ones; the rounds end when the edges no longer change, after a number
of rounds logarithmic in the size of a component. Every round is written to the shared folder, so
plans stay short and a lost executor repeats one round at most. Nothing reaches the driver but a
count and a checksum; Spark splits the join partition of a busy node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import staged


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """``pairs`` (u, v): neighbours of u that meet ``keep`` move to the smallest of u's circle."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = pairs.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("m <> u").select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (a, b): the smallest node it can reach."""
    pairs = staged(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    mark = None
    while True:
        # large star: both directions, larger neighbours only
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "v > u")
        # small star: each node with its smaller neighbours (u > v holds here)
        ordered = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        pairs = staged(_star(ordered, "true"), "stars")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)
