"""Figures of a search, of codecs, scans and posting lists, as rows for CSV."""

from __future__ import annotations

import csv
import logging
import time
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import codecs
from .operators.stats import bounds, postings
from .workers import importable

log = logging.getLogger("tallygrid")

#: Fixed: the columns of the figures of a search, of a scan and of a codec.
SEARCH_COLUMNS = ["codec", "overallTime", "queryCompilationTime", "preprocessingTime", "matchingTime", "convertTime", "invSize", "dimsSize", "topksSize", "comprRatio"]
SCAN_COLUMNS = ["array_size", "time", "throughput"]
CODEC_COLUMNS = ["codec", "array_size", "compr_size", "ratio", "time", "throughput"]


class Timings:
    """Seconds of named steps."""

    def __init__(self):
        self.rows: list[tuple[str, float]] = []

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.rows.append((name, time.perf_counter() - began))
        log.info("%s: %.3f s", *self.rows[-1])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "step string, seconds double")


def write_csv(rows: Iterable[dict], columns: Sequence[str], path: str) -> None:
    with Path(path).open("w", newline="") as f:
        out = csv.DictWriter(f, columns)
        out.writeheader()
        out.writerows(rows)


def search_figures(points: DataFrame, preds: DataFrame, config: Config, codec: str = "no") -> dict:
    """A search, run to its end: seconds of its steps, points and predicates, results, and bits of an id under the codec."""
    from .plans.engine import match_queries

    taken = Timings()
    with taken.step("preprocessingTime"):
        inv, dims = points.count(), preds.count()
    with taken.step("queryCompilationTime"):
        found = match_queries(points, preds, config)
        found._jdf.queryExecution().executedPlan()
    with taken.step("matchingTime"):
        top = found.select("qid", "id", "cnt").toArrow()
    with taken.step("convertTime"):
        ids = top.column("id").to_numpy()
    sizes = codec_sizes(points, [codec]).first()
    out = dict(taken.rows) | {"codec": codec, "invSize": inv, "dimsSize": dims, "topksSize": len(ids), "comprRatio": sizes["bits_per_int"] if sizes else 0.0}
    return {c: out.get(c, sum(x for _, x in taken.rows)) for c in SEARCH_COLUMNS}


def _timed(run, n: int) -> tuple[float, float]:
    began = time.perf_counter()
    run()
    took = max(time.perf_counter() - began, 1e-9)
    return took, n / took


def scan_figures(sizes: Sequence[int] = tuple(1 << k for k in range(0, 19, 3)), seed: int = 666) -> list[dict]:
    """Prefix sums of arrays, timed."""
    rng = np.random.default_rng(seed)
    arrays = [rng.integers(0, 1 << 16, n) for n in sizes]
    return [dict(zip(SCAN_COLUMNS, (len(x), *_timed(lambda x=x: np.cumsum(x), len(x))), strict=True)) for x in arrays]


def codec_figures(values: Sequence[int], names: Sequence[str] | None = None) -> list[dict]:
    """Each codec's size of, and time for, one list, there and back."""
    x, out = np.asarray(values, np.uint32), []
    for name in names or [*codecs.CODECS]:
        one = codecs.codec(name)
        words = one.encode(x)
        took = _timed(lambda one=one: one.decode(one.encode(x)), len(x))
        out.append(dict(zip(CODEC_COLUMNS, (name, len(x), len(words), 32 * len(words) / max(len(x), 1), *took), strict=True)))
    return out


def blocks_of_lists(points: DataFrame, block: int = 1_024) -> DataFrame:
    """(dim, value, part, ids): the posting lists, each in blocks of at most `block` ids."""
    return points.groupBy("dim", "value", F.floor(F.col("id") / block).alias("part")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def codec_sizes(points: DataFrame, names: Sequence[str], block: int = 1_024) -> DataFrame:
    """(codec, lists, ints, words, bits_per_int) over all posting lists, each in blocks of at most `block` ids."""
    importable(points.sparkSession)
    words = codecs.all_sizes(F.col("ids"), names)
    at = blocks_of_lists(points, block).select(F.size("ids").alias("n"), F.posexplode(words).alias("k", "w"))
    at = at.groupBy("k").agg(F.count("*").alias("lists"), F.sum("n").alias("ints"), F.sum("w").alias("words"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
    return at.select(name.alias("codec"), "lists", "ints", "words", (32.0 * F.col("words") / F.col("ints")).alias("bits_per_int"))


def analyze(points: DataFrame, codec: str | None = None, block: int = 1_024) -> DataFrame:
    """postings with the bytes that each takes as plain 32-bit ids, and, if a codec is named, encoded by blocks."""
    plain = postings(points).withColumn("bytes", 4 * F.col("n"))
    if codec is None:
        return plain
    importable(points.sparkSession)
    words = blocks_of_lists(points, block).select("dim", "value", F.get(codecs.all_sizes(F.col("ids"), [codec]), F.lit(0)).alias("w"))
    return plain.join(words.groupBy("dim", "value").agg((4 * F.sum("w")).alias("compressed_bytes")), ["dim", "value"])


def dump_table(points: DataFrame) -> DataFrame:
    """A line for each dim, as text: its bounds, and how many values and points it has."""
    return bounds(points).select("dim", F.format_string("dim %d: [%d, %d], %d values, %d points", "dim", "least", "most", "n_values", "n_points").alias("line"))


def dump_results(top: DataFrame) -> DataFrame:
    """A line for each query, as text: its results by rank, as id:count. A query has few."""
    at = top.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rnk", "id", "cnt"))).alias("found"))
    return at.select("qid", F.concat(F.format_string("query %s: ", F.col("qid").cast("string")), F.array_join(F.transform("found", lambda r: F.format_string("%s:%d", r["id"].cast("string"), r["cnt"])), " ")).alias("line"))


def dump_lists(points: DataFrame, block: int = 1_024) -> DataFrame:
    """Lines for each posting list, as text: its ids, those of `block` ids at a time that it has."""
    text = F.concat(F.format_string("dim %d value %s: ", "dim", F.col("value").cast("string")), F.array_join(F.col("ids").cast("array<string>"), " "))
    return blocks_of_lists(points, block).select("dim", "value", "part", text.alias("line"))
