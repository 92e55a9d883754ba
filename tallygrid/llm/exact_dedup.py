"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch of documents is reduced to (digest, largest doc_id,
copies), combined before its shuffle; a sort-merge anti-join against the index leaves the new digests, which are
appended. Texts themselves are never shuffled: 40 bytes a document are. How many buckets there are, and which folder of rows
stands, is noted in the index's own folder. Every batch adds a file to each bucket; where there are many, buckets are merged
into one file each, so that a batch reads the index in its order, without sorting it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import note, notes, remove, settings
from .shared import fold, materialize, named, staying, workspace

#: The most ids with digests (40 bytes each) that are broadcast to drop rows; more take a shuffled join.
DROPPED_ROWS = 500_000
#: Files of a bucket after which they are merged.
MERGE = 8
BY_BUCKET = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def digest(text: Column) -> Column:
    """SHA-256, as hex, of a text whose letters A-Z are folded; null counts as empty."""
    return F.sha2(fold(text), 256)


class DigestIndex:
    """A table (digest, keep_id, copies, batch), one row for each text ever kept, in a folder that outlives the session.

    Opening a folder that has an index continues it, with the number of buckets that it has; to ask for another is an error. A
    new one has as many as `buckets`, or as shuffle partitions. merge: files of a bucket after which they are merged. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, merge: int = MERGE):
        self.spark, self.merge = spark, merge
        self.path = path or workspace(spark, "digests")
        known = [tuple(map(int, x.split())) for x in notes(spark, f"{self.path}/state")]
        if not known:
            known = [(0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))]
            note(spark, f"{self.path}/state", "%d %d" % known[0])
        self.generation, self.buckets = max(known)
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index at {self.path} has {self.buckets} buckets, not {buckets}")
        self._open()

    def _open(self) -> None:
        self.name = named(self.spark, f"digest_index_{uuid.uuid4().hex[:12]}")
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, copies BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._rows(self.generation)}'"
        )

    def _rows(self, generation: int) -> str:
        return f"{self.path}/rows-{generation}"

    def compact(self) -> None:
        """Merge each bucket's files into one, in the order of digests. The old ones go once the new ones are noted."""
        after = self.generation + 1
        remove(self.spark, self._rows(after))  # of an attempt that failed
        table = named(self.spark, f"digest_index_{uuid.uuid4().hex[:12]}")
        with settings(self.spark, {BY_BUCKET: "false"}):  # a task reads a bucket, and so writes one
            self.rows().write.format("parquet").option("path", self._rows(after)).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table)
        note(self.spark, f"{self.path}/state", f"{after} {self.buckets}")
        remove(self.spark, self._rows(self.generation))
        self.generation = after
        self._open()

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _files(self) -> int:
        """The most that a bucket has, if all have as many."""
        return -(-len(self.rows().inputFiles()) // self.buckets)

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Add a batch and return, for each of its rows, (id_col, keep_id, group_size, kept, text_sha256).

        Of equal texts in the batch the row with the largest id stays, unless the index already holds the text: then
        none of the batch stays, and keep_id is the id recorded when the text came first. group_size counts the copies
        in the batch, and those recorded with the text before. Null texts count as empty, and empty texts are equal.
        Rows with a null id are never marked; where no copy has an id, keep_id is null. Rows that repeat an id and a text
        are copies that share the mark. A batch with a name can be added again, after a failure say: what it added itself
        counts as new, so the result is that of the first time. (keep() returns one row of each text that is new, also of these.) Other columns
        are ignored, whatever their names.
        """
        mine = F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False))
        return self._judged(docs, id_col, text_col, batch).select(
            F.col("id").alias(id_col), "keep_id", "group_size", (mine & F.col("new")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
        )

    def _judged(self, docs: DataFrame, id_col: str, text_col: str, batch: str | None) -> DataFrame:
        """Add a batch and return, for each of its rows, (id, digest, keep_id, group_size, new: the text wasn't known)."""
        batch = batch or uuid.uuid4().hex
        if self._files() >= self.merge:
            self.compact()
        seen = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(digest(F.col(text_col))).alias("digest")), "digest-batch")
        groups = seen.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("copies"))
        known = self.rows()
        fresh = groups.hint("merge").join(known.select("digest"), "digest", "left_anti")
        with settings(self.spark, {IN_ORDER: "true"}):  # of buckets with one file, which needn't be sorted again
            (
                fresh.withColumn("batch", F.lit(batch)).select("digest", "keep_id", "copies", "batch")
                .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)
            )
        found = self.rows().select("digest", "keep_id", F.col("copies").alias("first_copies"), (F.col("batch") == batch).alias("new"))
        sizes = groups.select("digest", "copies").join(found, "digest").select(
            "digest", "keep_id", "new", F.when(F.col("new"), F.col("copies")).otherwise(F.col("copies") + F.col("first_copies")).alias("group_size")
        )
        # Written, so that both sides of the last join are shuffled for it and adaptive execution can split a digest that
        # many rows share.
        sizes = materialize(sizes, "digest-sizes")
        return seen.join(sizes, "digest").select("id", "digest", "keep_id", "group_size", "new")

    def keep(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Add a batch (see dedup) and return one row of each text that the index didn't hold, with all its columns.

        It is one with the largest id, or without an id if no copy has one; of rows that repeat both, any one.
        """
        chosen = F.col("new") & F.col("id").eqNullSafe(F.col("keep_id"))
        pairs = self._judged(docs, id_col, text_col, batch).groupBy("id", "digest").agg(F.count("*").alias("n"), F.max(chosen.cast("long")).alias("m"))
        return staying(docs, [F.col(id_col).cast("long"), F.unhex(digest(F.col(text_col)))], pairs, DROPPED_ROWS)
