"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours are linked to the smallest node around; ``large`` moves the larger ones only."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.union(turned) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(around.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")))
    met = around.join(least, "a")
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return materialize(moved.where("a <> b").distinct())


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node that has an edge; a component is named by its smallest node.

    ``edges`` has columns ``a`` and ``b`` of one type.  Both steps keep components and shrink every tree,
    so a number of rounds of the order of the logarithm of the longest path ends in stars.  The links stay
    in tables of the shared folder; the driver compares a count and a checksum.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct())
    before = _state(now)
    while before[0]:
        now = _star(_star(now, large=True), large=False)
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
