"""The k best rows of each query, pages, padding, and results of several tables put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .match import hinted


def top_k(counts: DataFrame, k: int | Column, *, page: int = 1, descending_ids: bool = False, extra: tuple[str, ...] = (), per: tuple[str, ...] = ("qid",)) -> DataFrame:
    """counts with rnk, from 1, for the k with the largest cnt (ties: the least id, or the greatest): page 1, or another.

    k may be a column, to differ by query.
    """
    ids = F.desc("id") if descending_ids else F.asc("id")
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("cnt"), ids, *extra))
    at = counts.withColumn("rnk", rank)
    return at.where((F.col("rnk") > (page - 1) * k) & (F.col("rnk") <= page * k)) if page > 1 else at.where(F.col("rnk") <= k)


def pad(top: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, cnt, rnk) with k rows for each of the queries (qid): what is missing has id and cnt 0."""
    places = queries.select("qid").distinct().select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rnk"))
    at = places.join(top, ["qid", "rnk"], "left")
    return at.select("qid", F.coalesce("id", F.lit(0)).alias("id"), F.coalesce("cnt", F.lit(0)).alias("cnt"), "rnk")


def id_offsets(sizes: DataFrame, order: list[str], n: str = "n") -> DataFrame:
    """sizes (a row for each table) with the sum of what stands before, by which a table's ids are shifted."""
    return sizes.withColumn("offset", F.coalesce(F.sum(n).over(Window.orderBy(*order)) - F.col(n), F.lit(0)))


def merge(results: DataFrame, offsets: DataFrame, on: list[str], k: int, **how) -> DataFrame:
    """The top k of each query over the results of several tables, their ids shifted to be those of the whole."""
    at = results.join(hinted(offsets.select(*on, "offset")), on)
    return top_k(at.select("qid", (F.col("id") + F.col("offset")).alias("id"), "cnt"), k, **how)
