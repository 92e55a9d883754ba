"""Made data for trials of codecs and scans, by seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def geometric(spark: SparkSession, n: int, p: float = 0.005, seed: int = 666) -> DataFrame:
    """(id, value): failures before a success of probability p."""
    u = 1 - F.rand(seed)
    return spark.range(n).select("id", F.floor(F.log(u) / F.log(F.lit(1 - p))).cast("long").alias("value"))


def uniform(spark: SparkSession, n: int, least: int = 1, most: int = 65_536, seed: int = 666) -> DataFrame:
    return spark.range(n).select("id", (F.floor(F.rand(seed) * (most - least + 1)) + least).cast("long").alias("value"))


def sorted_lists(values: DataFrame, length: int = 1_024, gaps: bool = False) -> DataFrame:
    """(part, values): lists of at most `length` values, sorted; gaps: the values are the differences."""
    at = values.groupBy(F.floor(F.col("id") / length).alias("part")).agg(F.sort_array(F.collect_list(F.struct("id", "value"))).alias("x"))
    plain = F.transform("x", lambda v: v.value)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    summed = F.aggregate(plain, start, lambda s, d: F.struct((s["at"] + d).alias("at"), F.concat(s["out"], F.array(s["at"] + d)).alias("out")))["out"]
    return at.select("part", (summed if gaps else F.sort_array(plain)).alias("values"))
