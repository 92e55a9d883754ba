"""Connected components by alternating large-star and small-star rounds, wholly in DataFrames.

Each round is an aggregation (combined before its shuffle) and a join on the same key, whose hot side (a hub) adaptive
execution can split; its result is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for each node of an edge that isn't a loop; component is the smallest node that it reaches.

    Edges have no direction. Edges with a null end and loops count for nothing; repeated edges count once; no edges
    give no rows.
    """
    def ends(a, b) -> DataFrame:
        return edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))

    now = materialize(ends(src, dst).where((F.col(src) != F.col(dst)) & F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct(), "edges")
    before = None
    while before != (mark := _mark(now)):
        before = mark
        now = materialize(_small_star(_large_star(now)), "stars")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on the least of itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()
