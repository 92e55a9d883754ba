"""Tables in clusters: making them, routing queries to them, and documents that name clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import nearest

QUERY_SCHEMA = "topk int, queries array<struct<content: array<int>, clusters: array<int>>>"


def parse_queries(documents: DataFrame, json_col: str = "value") -> DataFrame:
    """(doc, topk, qid, content, clusters) from JSON documents {"topk", "queries": [{"content", "clusters"}]}.

    A document that isn't JSON, or lacks a field, or has one of another type, is dropped whole. qid is the query's place.
    """
    at = documents.withColumn("doc", F.monotonically_increasing_id()) if "doc" not in documents.columns else documents
    strict = F.from_json(F.col(json_col), QUERY_SCHEMA, {"mode": "PERMISSIVE"})
    at = at.select("doc", strict.alias("q"))
    whole = F.forall("q.queries", lambda x: x.content.isNotNull() & x.clusters.isNotNull() & F.forall(x.content, lambda v: v.isNotNull()) & F.forall(x.clusters, lambda v: v.isNotNull()))
    at = at.where(F.col("q.topk").isNotNull() & F.col("q.queries").isNotNull() & whole)
    return at.select("doc", F.col("q.topk").alias("topk"), F.posexplode("q.queries").alias("qid", "x")).select("doc", "topk", "qid", "x.content", "x.clusters")


def routed(queries: DataFrame, content_col: str = "content", clusters_col: str = "clusters") -> DataFrame:
    """A row for each query and each cluster that it names, once."""
    return queries.withColumn("cluster", F.explode(F.array_distinct(clusters_col)))


def search_clusters(points: DataFrame, preds: DataFrame, k: int, exact: bool = True, **how) -> DataFrame:
    """The top k of each query over its clusters: points and preds both have a column cluster.

    Points of an index that was saved by cluster are read from the folders of clusters that are asked only: which these are is
    known when the predicates are, and the scan waits for that (dynamic partition pruning).
    """
    return nearest(points, preds, k, exact=exact, on=("cluster",), **how)


def cluster_rows(rows: DataFrame, k: int = 20, seed: int = 0, values_col: str = "values") -> DataFrame:
    """rows with the cluster of each, by k-means on its values."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    at = rows.withColumn("features", array_to_vector(F.col(values_col).cast("array<double>")))
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(at).transform(at).drop("features")


def save_clusters(rows: DataFrame, path: str, shards: int = 1) -> None:
    """A folder for each cluster, its rows dealt over shards."""
    at = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    at.repartition("cluster", "shard").write.mode("overwrite").partitionBy("cluster", "shard").parquet(path)


def make_queries(rows: DataFrame, topk: int, clusters: int, values_col: str = "values", most: int = 1_000) -> DataFrame:
    """Query documents (value) for each cluster, asking for the rows that it has; a document has `most` queries about, so
    that a large cluster has several."""
    at = rows.where(F.col("cluster") < clusters)
    n = at.groupBy("cluster").agg(F.ceil(F.count("*") / most).alias("documents"))
    at = at.join(n, "cluster").withColumn("document", F.pmod(F.xxhash64(values_col), "documents"))
    at = at.groupBy("cluster", "document").agg(F.collect_list(F.struct(F.col(values_col).alias("content"), F.array("cluster").alias("clusters"))).alias("queries"))
    return at.select(F.to_json(F.struct(F.lit(topk).alias("topk"), "queries")).alias("value"))
