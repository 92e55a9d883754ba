"""The online service: query documents arrive as a stream, and each batch is searched in a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import OnlineConfig
from ..operators.clusters import parse_queries, routed
from ..operators.points import bag_points, vector_points
from ..operators.predicates import widen
from ..operators.shared import nearest
from ..operators.topk import id_offsets
from ..sources.index import load_index, save_index
from ..sources.rows import read_clusters
from ..workspace import workspace

#: How rows become points: by place, or as bags.
VECTORS, BAGS = 0, 1


def load_points(spark: SparkSession, config: OnlineConfig) -> DataFrame:
    """(id, dim, value, cluster) of the files <data_file>_<cluster>_<shard>.csv; ids count on from file to file."""
    rows = read_clusters(spark, f"{config.data_file}_*_*.*").where(F.col("cluster") < config.num_of_cluster)
    sizes = rows.groupBy("cluster", "shard").agg(F.count("*").alias("n"))
    rows = rows.join(id_offsets(sizes, ["cluster", "shard"]).select("cluster", "shard", "offset"), ["cluster", "shard"])
    rows = rows.select((F.col("id") + F.col("offset")).alias("key"), "cluster", "values").select(F.struct("key", "cluster").alias("id"), "values")
    made = bag_points(rows) if config.search_type == BAGS else vector_points(rows)
    return made.select("*", F.col("id.cluster").alias("cluster")).withColumn("id", F.col("id.key"))


def answer(points: DataFrame, documents: DataFrame, radius: int = 0, selectivity: float = 0.0, search_type: int = VECTORS, rows: int | None = None, by_id: bool = False) -> DataFrame:
    """(doc, qid, id, cnt, rnk): for each query of valid documents the topk best rows of the clusters that it names.

    points have a column cluster; ids are those of the whole. Queries of one batch are searched together. by_id: the
    points are dealt by id already.
    """
    asked = parse_queries(documents)
    key = F.struct("doc", "qid")
    at = routed(asked).select(key.alias("key"), "topk", "cluster", F.posexplode("content").alias("place", "value"))
    dim = F.lit(0) if search_type == BAGS else F.col("place")
    preds = at.select(F.col("key").alias("qid"), "cluster", F.col("place").alias("ord"), dim.alias("dim"), (F.col("value") - radius).alias("lo"), (F.col("value") + radius).alias("up"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("selectivity"))
    if selectivity > 0:
        grown = widen(preds.drop("cluster").distinct(), points.select("id", "dim", "value"), selectivity, rows)
        preds = grown.join(preds.select("qid", "cluster").distinct(), "qid")
    most = asked.agg(F.max("topk")).first()[0] or 0  # one row
    found = nearest(points, preds, max(most, 1), exact=not radius and not selectivity, on=("cluster",), by_id=by_id)
    found = found.join(asked.select(key.alias("qid"), "topk").distinct(), "qid").where("rnk <= topk")
    return found.select("qid.doc", "qid.qid", "id", "cnt", "rnk")


def stored(points: DataFrame, partitions: int | None = None) -> DataFrame:
    """The points as an index with a folder for each cluster, in the shared folder: a batch reads those of the clusters that its
    queries name, and no executor has to last as long as the service does."""
    spark = points.sparkSession
    save_index(points, path := workspace(spark, "service-index"), partitions, by=("cluster",))
    return load_index(spark, path)


def serve(spark: SparkSession, points: DataFrame, source: str, target: str, checkpoint: str, interval: str = "1 second", once: bool = False, lines: bool = False, **how) -> StreamingQuery:
    """Search the JSON documents (one a file, or one a line) that appear in source, and write results for each batch to target."""
    index = stored(points)
    stream = spark.readStream.option("wholetext", not lines).schema("value string").text(source)

    def run(batch: DataFrame, number: int) -> None:
        answer(index, batch, by_id=True, **how).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def serve_configured(spark: SparkSession, config: OnlineConfig, source: str, target: str, checkpoint: str, **how) -> StreamingQuery:
    """The service of a settings file."""
    growth = config.selectivity if config.adaptive else 0.0
    return serve(spark, load_points(spark, config), source, target, checkpoint, radius=config.radius, selectivity=growth, search_type=config.search_type, **how)


def serve_socket(spark: SparkSession, points: DataFrame, host: str, port: int, target: str, checkpoint: str, **how) -> StreamingQuery:
    """The same for documents that come as lines over a socket (a source for trials, which can't be replayed)."""
    index = stored(points)
    stream = spark.readStream.format("socket").option("host", host).option("port", port).load()
    run = lambda batch, number: answer(index, batch, by_id=True, **how).write.mode("overwrite").parquet(f"{target}/batch={number}")
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
