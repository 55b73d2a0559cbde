"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step is a partial minimum per node and one join on the node, so a hub's neighbours are never gathered in one task.
The number of steps grows with the logarithm of the graph's size. Edges are cut from their lineage in the shared
checkpoint folder after every round, and the only thing the driver sees is a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v")
    both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    ends = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """``node, component``: every node of an edge, with the least node of its component.

    Direction, repeated edges, loops and extra columns do not matter; an edge with a null end is left out. A node that
    has only a loop is its own component. No edges give no rows.
    More rounds than ``max_rounds``, which no graph of less than 2^50 nodes should need, are an error, never a part of the result.
    """
    whole = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    loops = whole.where("u = v").select(F.col("u").alias("node"))
    now = cut_lineage(whole.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        now = cut_lineage(_star(_star(now, large=True), large=False))
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components are not done after {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    linked = found.unionByName(roots)
    alone = loops.distinct().join(linked.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return linked.unionByName(alone)
