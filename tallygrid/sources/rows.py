"""Rows of integers from delimited text and memory, with ids in the order of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import to_int
from ..operators.predicates import radius_predicates
from ..operators.stats import prefix_sums

#: Up to so many first lines are taken by the driver, which reads the start of the file alone.
FEW = 10_000
ROW_SCHEMA = "id long, values array<int>"


def with_row_ids(lines: DataFrame, id_col: str = "id") -> DataFrame:
    """lines (of a file source) with their ordinals from 0, by file and place in it.

    Counts of each block are added up, so that lines are read twice and never gathered.
    """
    at = lines.select("*", F.monotonically_increasing_id().alias("mid"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    blocks = at.groupBy("f", "b").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("f", "b")) - F.col("n")  # one row for each block of a file
    blocks = blocks.select("f", "b", (before - F.col("first")).alias("shift"))
    return at.join(blocks, ["f", "b"]).select(*lines.columns, (F.col("mid") + F.col("shift")).alias(id_col))


def fields(line: Column) -> Column:
    """What stands between runs of commas and blanks; empty fields are left out."""
    return F.array_remove(F.split(line, "[, ]+"), "")


def read_rows(spark: SparkSession, path: str, num: int = -1, convert=to_int, id_col: str = "id") -> DataFrame:
    """(id, values) from text: the first num rows, or all if num is below 0.

    Fields stand between commas or blanks, a trailing one is allowed; what isn't a number is 0, or what `convert` (from
    Column to Column) makes of it. Empty lines are rows without values. A missing file is an error.
    """
    lines = spark.read.text(path)
    if 0 <= num <= FEW and len(lines.inputFiles()) == 1:  # in the order of the file, of which no more is read than they need
        first = [(k, r["value"]) for k, r in enumerate(lines.take(num))]
        rows = spark.createDataFrame(first, f"`{id_col}` long, value string")
    else:
        rows = with_row_ids(lines, id_col)
        rows = rows.where(F.col(id_col) < num) if num >= 0 else rows
    return rows.select(id_col, F.transform(fields(F.col("value")), convert).alias("values"))


def read_predicates(spark: SparkSession, path: str, num: int = -1) -> DataFrame:
    """(qid, dim, value, selectivity, weight) from long-form text; lines without five fields are skipped."""
    rows = with_row_ids(spark.read.text(path)).select("id", fields(F.col("value")).alias("x")).where(F.size("x") == 5)
    if num >= 0:
        rows = rows.orderBy("id").limit(num)
    x = F.col("x")
    return rows.select(to_int(x[0]).alias("qid"), to_int(x[1]).alias("dim"), to_int(x[2]).alias("value"), F.coalesce(x[3].try_cast("float"), F.lit(0.0)).cast("float").alias("selectivity"), F.coalesce(x[4].try_cast("float"), F.lit(0.0)).cast("float").alias("weight"))


def read_radius_queries(spark: SparkSession, path: str, radius: int, num: int = -1, dims: int | None = None, selectivity: float = 0.0) -> DataFrame:
    """Predicates of row-form queries: each value, give or take radius, its lower end 0 at least; the place is the dim."""
    at = radius_predicates(read_rows(spark, path, num), radius, dims)
    return at.withColumn("lo", F.greatest("lo", F.lit(0))).withColumn("selectivity", F.lit(float(selectivity)))


def read_clusters(spark: SparkSession, pattern: str) -> DataFrame:
    """(cluster, shard, id, values) from files NAME_CLUSTER_SHARD.csv, or folders of that name with parts of it; ids count within
    a file."""
    lines = spark.read.text(pattern).select("value", "_metadata")
    name = F.col("_metadata.file_path")
    named = r"_(\d+)_(\d+)\.(?:csv|dat)(?:/[^/]+)?$"
    rows = with_row_ids(lines.where(name.rlike(named)))
    at = rows.withColumn("cluster", F.regexp_extract(name, named, 1).cast("int")).withColumn("shard", F.regexp_extract(name, named, 2).cast("int"))
    first = at.groupBy("cluster", "shard").agg(F.min("id").alias("first"))
    return at.join(first, ["cluster", "shard"]).select("cluster", "shard", (F.col("id") - F.col("first")).alias("id"), F.transform(fields(F.col("value")), to_int).alias("values"))


def from_rows(spark: SparkSession, rows: Sequence[Sequence[int]]) -> DataFrame:
    return spark.createDataFrame([(k, list(x)) for k, x in enumerate(rows)], ROW_SCHEMA)


def from_csr(spark: SparkSession, data: Sequence[int], index: Sequence[int]) -> DataFrame:
    """Rows that start at each index of flat data."""
    ends = [*index[1:], len(data)]
    return from_rows(spark, [data[a:b] for a, b in zip(index, ends, strict=True)])


def from_flat(values: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, values) from tables of flat data: values (place, value), and starts (start), the places where rows begin.

    Rows are numbered by their starts; of rows that start at one place all but the last are empty. What stands before the
    first start belongs to no row. Places are sorted by ranges; a row's values come together, as they do in its array.
    """
    kinds = dict(values.dtypes)
    marks = starts.select(F.col("start").alias("place"), F.lit(0).alias("kind"), F.monotonically_increasing_id().alias("tie"), F.lit(None).cast(kinds["value"]).alias("value"), F.lit(1).cast("long").alias("n"))
    flat = values.select("place", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("tie"), "value", F.lit(0).cast("long").alias("n"))
    at = prefix_sums(marks.unionByName(flat), ["place", "kind", "tie"], "n")
    held = at.where("kind = 1 AND before > 0").groupBy((F.col("before") - 1).alias("id")).agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("found"))
    rows = at.where("kind = 0").select(F.col("before").alias("id")).join(held, "id", "left")
    return rows.select("id", F.coalesce(F.transform("found", lambda x: x["value"]), F.array().cast(f"array<{kinds['value']}>")).alias("values"))
