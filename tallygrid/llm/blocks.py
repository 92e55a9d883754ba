"""Blocks of documents, and questions that blocks ask of all others.

A block is a bounded number of documents, kept as one row of a table bucketed by block. What a block needs to know of the
whole corpus (how often a string occurs, say) it asks once for each distinct thing, packed into one message for each
bucket of hashes; each bucket answers every block that asked. Messages are combined before the shuffle, so a string that
a third of all rows hold weighs no more in its bucket than one a block, and answers come back to the block without
moving its documents again.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import named, workspace

Message = tuple[int, bytes]
#: What goes to a Python worker at once, and the rows of Parquet that are decoded at once. A block's row is about a megabyte: by
#: Spark's defaults (64 MB and 4,096 rows) all blocks of a task are in one batch, in the JVM (twice, as buffers double) and in the worker.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "64"}


def bounded(spark: SparkSession) -> None:
    """Bound the session's batches, from now on, as the last stages run when results are written. No result depends on it; what
    is bounded more tightly stays."""
    for key, value in BATCHES.items():
        now = spark.conf.get(key, None)
        if now is None or _number(now) > _number(value):
            spark.conf.set(key, value)


def _number(size: str) -> int:
    """Of a setting: with a unit, or without."""
    digits = size.lower().rstrip("bkmg")
    return int(digits) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[size.lower()[len(digits) :].rstrip("b")]


def buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def store(rows: DataFrame, label: str) -> DataFrame:
    """A table of rows with a column block, bucketed by it, in the shared folder."""
    name = named(rows.sparkSession, f"{label}_{uuid.uuid4().hex[:12]}")
    at = workspace(rows.sparkSession, label)
    rows.write.format("parquet").option("compression", "zstd").option("path", at).bucketBy(buckets(rows), "block").saveAsTable(name)
    return rows.sparkSession.table(name)


@functools.cache
def _allocator():
    """The C library's, told to take large arrays from the system and so to give them back; else None."""
    lib = ctypes.CDLL(None)
    if not hasattr(lib, "malloc_trim") or not hasattr(lib, "mallopt"):
        return None
    lib.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    return lib


def tidy() -> None:
    """Give memory that is free back to the system: two workers and a JVM share an executor's."""
    pa.default_memory_pool().release_unused()
    if lib := _allocator():
        lib.malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back after each batch, and when the task ends: workers wait for others with what they hold."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in run(batches):
                yield out
                del out
                tidy()
        finally:
            tidy()

    return wrapped


def block_ids() -> Iterator[int]:
    """Distinct over all tasks of a stage, and the same when a task is run again."""
    k = TaskContext.get().partitionId() << 20
    while True:
        tidy()
        yield k
        k += 1


def grouped(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(first column, second column as UTF-8) in parts of about `limit` bytes and at most about a million rows; null counts as empty."""
    for batch in batches:
        texts, lo, size = batch.column(1), 0, 0
        raw = []
        for k in range(len(texts)):
            x = (texts[k].as_py() or "").encode("utf-8", "surrogatepass")
            raw.append(x)
            size += len(x)
            if size >= limit or k - lo >= 1_000_000 or k == len(texts) - 1:
                yield batch.column(0)[lo : k + 1], raw
                raw, lo, size = [], k + 1, 0


def ask(table: DataFrame, columns: list[str], messages: Callable[..., Iterable[Message]]) -> DataFrame:
    """(block, bucket, payload): what `messages` makes of each block, given the columns' values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                block, *values = (c[k].as_py() for c in batch.columns)
                for bucket, payload in messages(*values):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bucket": pa.array([bucket], pa.int32()), "payload": pa.array([payload], pa.binary())})
                tidy()

    return table.select("block", *columns).mapInArrow(run, "block long, bucket int, payload binary")


def answer(asked: DataFrame, reduce: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(block, got): for each block its buckets' answers. `reduce` has all messages to a bucket and answers each."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        payloads = reduce(rows.column("payload").to_pylist())
        tidy()
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "payload": pa.array(payloads, pa.binary())})

    return gather(asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, payload binary"))


def gather(answers: DataFrame) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias("got"))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays, by the bytes of equal weight of their elements, compressed."""
    parts = [len(a).to_bytes(8, "little") + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.compress(b"".join(parts), 1)


def unsqueeze(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    for kind in kinds:
        n, size = int.from_bytes(raw[at : at + 8], "little"), np.dtype(kind).itemsize
        at += 8
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def by_bucket(hashes: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted hashes (64 bits, unsigned) by bucket, of n with equal ranges; empty ones are left out."""
    at = np.searchsorted(hashes, np.array([(k << 64) // n for k in range(1, n)], np.uint64)) if n > 1 else np.zeros(0, np.int64)
    at = [0, *at.tolist(), len(hashes)]
    for k in range(n):
        if at[k] < at[k + 1]:
            yield k, slice(at[k], at[k + 1])
