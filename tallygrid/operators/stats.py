"""What an index holds: bounds, posting lists and their distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import materialize


def bounds(points: DataFrame) -> DataFrame:
    """(dim, least, most, n_values, n_points)."""
    at = postings(points).groupBy("dim")
    return at.agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n_values"), F.sum("n").alias("n_points"))


def postings(points: DataFrame) -> DataFrame:
    """(dim, value, n, first_id, last_id) for each posting list."""
    return points.groupBy("dim", "value").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def posting_size(points: DataFrame, dim: int, value: int) -> int:
    return points.where((F.col("dim") == dim) & (F.col("value") == value)).count()


def contains(points: DataFrame, dim: int, value: int) -> bool:
    """Whether the value lies within the dim's bounds; it need not occur."""
    b = points.where(F.col("dim") == dim).agg(F.min("value"), F.max("value")).first()
    return b[0] is not None and b[0] <= value <= b[1]


def deltas(points: DataFrame, block: int = 1_024) -> DataFrame:
    """(dim, value, id, delta): the distance to the id before in its posting list, the first to 0.

    Long lists are ordered in ranges of ids; a range takes its first predecessor from the greatest id of those before.
    """
    at = points.withColumn("range", F.floor(F.col("id") / (block * block)))
    own = Window.partitionBy("dim", "value", "range").orderBy("id")
    last = at.groupBy("dim", "value", "range").agg(F.max("id").alias("last"))
    before = last.select("dim", "value", "range", F.lag("last").over(Window.partitionBy("dim", "value").orderBy("range")).alias("before"))
    at = at.withColumn("prev", F.lag("id").over(own)).join(before, ["dim", "value", "range"])
    return at.select("dim", "value", "id", (F.col("id") - F.coalesce("prev", "before", F.lit(0))).alias("delta"))


def prefix_sums(df: DataFrame, order: Sequence[str | Column], value: str, into: str = "before") -> DataFrame:
    """df with the sum of `value` over all rows that precede in the order, which should be total.

    Rows are sorted by ranges, each summed by itself; the ranges' sums (a row for each) are added up.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = materialize(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = at.groupBy("__range").agg(F.sum(value).alias("__sum"))
    offsets = sizes.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__offset"))
    own = F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn(into, own).join(F.broadcast(offsets), "__range")  # a row for each shuffle partition
    return at.withColumn(into, F.coalesce(into, F.lit(0)) + F.coalesce("__offset", F.lit(0))).drop("__range", "__offset")


def list_sizes(points: DataFrame) -> DataFrame:
    """How many posting lists have each length."""
    return postings(points).groupBy("n").agg(F.count("*").alias("n_lists"))
