"""Connected components of a graph of any size, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.session import materialise


def _toward_least(edges: DataFrame) -> DataFrame:
    """One round on distinct edges (u, v), u > v: every node is tied to the least node that its neighbours know."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lowest = larger.groupBy("u").agg(F.min("v").alias("m"))
    tied = larger.join(lowest, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); a component is named by its least node.

    Each round is a few shuffles of the edges and is written, so a lost executor costs a round's part at most; rounds grow
    with the logarithm of a component's width. Edges from a node to itself and repeated edges change nothing.
    """
    current = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    current = materialise(current, f"{label}-edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = state(current)
    while before[0]:
        current = materialise(_toward_least(current), f"{label}-edges")
        after = state(current)
        if after == before:
            break
        before = after
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
