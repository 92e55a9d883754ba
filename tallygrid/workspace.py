"""Work files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import uuid
from collections.abc import Collection, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the cluster names no shared folder, as in tests.
LOCAL_ROOT = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this machine, if all executors run in this process too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_local_root(spark.sparkContext.applicationId)}"


@functools.cache
def _local_root(application: str) -> str:
    """Removed when Python ends."""
    own = f"{LOCAL_ROOT}/{application}"
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


#: By application, the paths that workspace() gave and the tables that were made at some of them.
_PATHS: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}


def workspace(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def named(spark: SparkSession, table: str) -> str:
    """A table's name, once it is noted for clean()."""
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(table)
    return table


def mark(spark: SparkSession) -> tuple[int, int]:
    """For clean(): what is made from now on."""
    app = spark.sparkContext.applicationId
    return len(_PATHS.get(app, [])), len(_TABLES.get(app, []))


def clean(spark: SparkSession, since: tuple[int, int], keep: Collection[str] = ()) -> None:
    """Drop the work tables and folders made since a mark, but for those to keep. Results that read them are lost unless
    they were written."""
    app = spark.sparkContext.applicationId
    paths, tables = _PATHS.get(app, []), _TABLES.get(app, [])
    for table in tables[since[1] :]:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in paths[since[0] :]:
        if path not in keep:
            remove(spark, path)
    del tables[since[1] :], paths[since[0] :]
    paths += keep


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, and outlives lost executors."""
    spark, path = df.sparkSession, workspace(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _open(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file of bounded size, wherever Spark can write."""
    at, store = _open(spark, path)
    out = store.create(at)
    out.write(bytearray(data))
    out.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    at, store = _open(spark, path)
    store.delete(at, True)


def rename_files(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Give the files of a folder that Spark has written another ending. Names only are changed."""
    at, store = _open(spark, path)
    for x in store.listStatus(at):
        if (name := x.getPath().getName()).endswith(old) and not name.startswith(("_", ".")):
            store.rename(x.getPath(), spark._jvm.org.apache.hadoop.fs.Path(at, name.removesuffix(old) + new))


def notes(spark: SparkSession, path: str) -> list[str]:
    """The lines noted in a folder (few), in no order; none if it isn't there."""
    at, store = _open(spark, path)
    return [r["value"] for r in spark.read.text(path).collect()] if store.exists(at) else []


def note(spark: SparkSession, path: str, line: str) -> None:
    """Add a line to a folder's, as a file that is there whole or not at all."""
    spark.range(1, numPartitions=1).select(F.lit(line).alias("value")).write.mode("append").text(path)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings are these within, and what they were after it."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
