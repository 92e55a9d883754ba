"""A corpus-cleaning pipeline of the operators in tallygrid.llm: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrid.llm import bpe, decontam, exact_dedup, forest, langid
from tallygrid.llm.queries import table, vocabulary
from tallygrid.llm.shared import importable
from tallygrid.workspace import clean, mark, settings, workspace

#: What goes to a Python worker at once, and the rows of Parquet that are decoded at once. Texts have kilobytes: by Spark's
#: defaults (10,000 and 4,096 rows) such arrays would be tens of megabytes each, in the JVM and in every worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def bounded(spark: SparkSession) -> None:
    """Bound the session's batches, from now on, since stages run when their results are written. No result depends on it."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no language, or none with a score of 0.5."""
    bounded(spark)
    importable(spark)
    return langid.accept(docs, vocabulary("piece_bpe_32k.model"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps one document: that with the largest doc_id, or one without if none has one."""
    bounded(spark)
    return exact_dedup.DigestIndex(spark).keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, keeps one document: that with the least doc_id, or one without if none has one."""
    bounded(spark)
    importable(spark)
    return forest.keep(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of a benchmark item."""
    bounded(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    bounded(spark)
    importable(spark)
    return bpe.encode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("encode", encode)]

#: Byte-pair encoding can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again; what a stage left behind is then removed. The session's
    settings are afterwards what they were."""
    docs = table(spark, sf_dir, "documents")
    with settings(spark, BATCHES):
        for name, stage in STAGES:
            before = mark(spark)
            stage(spark, docs, sf_dir).write.parquet(path := workspace(spark, f"stage-{name}"))
            clean(spark, before, keep=[path])
            docs = spark.read.parquet(path)
    return docs
