"""Connected components of a graph in DataFrames, by alternating stars.

Each round links every node to the smallest node it knows of, first among its
larger neighbours, then among the smaller; the edges end as stars around the
smallest node of each component. Edges stay distributed, each round is written
to the shared folder, and only two sums come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_classes, materialise


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    joined = join_classes(both, least, "u", "degree", 2 * n_edges)
    if large:
        return joined.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = least.where("u <> m").select("u", F.col("m").alias("v"))
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges (u long, v long) -> (node, component): every node with an edge, and
    the smallest node reachable from it. No edges: an empty result."""

    def facts(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = facts(edges)
    for _ in range(rounds if before.n else 0):
        half = materialise(_star(edges, True, before.n), "edges")
        after = materialise(_star(half, False, before.n), "edges")
        discard(edges, half)
        edges, now = after, facts(after)
        if now == before:
            break
        before = now
    else:
        if before.n:
            raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
