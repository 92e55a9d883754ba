"""Indexes on disk, and results as text.

An index is a folder of segments, each a table of points bucketed by id and sorted by dim and value within a bucket, with the
bounds of its dims. So counts by id are complete where a bucket is read, a query's ranges leave out pages of each bucket,
and bounds leave out segments. What is added becomes a segment of its own; segments of like size are merged, so that there
are few. `state` notes which segments stand: what was written by an attempt that failed isn't among them.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.stats import bounds
from ..workspace import named, note, notes, remove, settings

#: Segments of one size class (each holds up to so many times the points of the one below) that are merged into one.
MERGED = 4
#: Ranges of a dim that are left when a scan is filtered; more are joined across their smallest gaps. Dims that are filtered.
RANGES, DIMS = 32, 1_024
#: Rows of a page, the least that a scan leaves out.
PAGE_ROWS = 5_000


def _state(spark: SparkSession, path: str) -> dict:
    lines = [json.loads(x) for x in notes(spark, f"{path}/state")]
    return max(lines, key=lambda x: x["n"]) if lines else {"n": 0, "segments": []}


def _put(spark: SparkSession, path: str, old: dict, **new) -> dict:
    new = old | new | {"n": old["n"] + 1}
    note(spark, f"{path}/state", json.dumps(new))
    return new


def _segment(points: DataFrame, path: str, state: dict) -> dict:
    """Write one; its name and number of points."""
    at, by = f"segment-{uuid.uuid4().hex[:12]}", state["by"]
    rows = points.select(*(c for c, _ in state["columns"]))
    table = named(points.sparkSession, f"index_{uuid.uuid4().hex[:12]}")
    writer = rows.repartition(state["buckets"], "id").write.format("parquet").option("path", f"{path}/{at}/points").option("parquet.page.row.count.limit", PAGE_ROWS)
    writer = writer.bucketBy(state["buckets"], "id").sortBy("dim", "value", "id")
    (writer.partitionBy(*by) if by else writer).saveAsTable(table)
    bounds(points.sparkSession.table(table)).coalesce(1).write.parquet(f"{path}/{at}/bounds")
    n = points.sparkSession.read.parquet(f"{path}/{at}/bounds").agg(F.coalesce(F.sum("n_points"), F.lit(0))).first()[0]
    return {"at": at, "points": n}


def save_index(points: DataFrame, path: str, partitions: int | None = None, by: tuple[str, ...] = ()) -> None:
    """Make an index of points (id, dim, value, and what else they have), in place of what the folder held.

    partitions: the number of buckets, by default that of shuffle partitions. by: columns of folders, such as the cluster:
    folders that a search doesn't ask for aren't read.
    """
    spark = points.sparkSession
    old = _state(spark, path)
    kinds = dict(points.dtypes)
    buckets = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    fresh = old | {"buckets": buckets, "by": [*by], "columns": [(c, kinds[c]) for c in points.columns if c not in by] + [(c, kinds[c]) for c in by]}
    _put(spark, path, fresh, segments=[_segment(points, path, fresh)])
    _remove(spark, path, old["segments"])


def append_index(points: DataFrame, path: str) -> None:
    """Add points of rows that the index doesn't have, as a segment; merge segments when there are MERGED of one size class.

    All points of a row come together: a row of two segments would be counted twice.
    """
    spark = points.sparkSession
    state = _state(spark, path)
    if not state["segments"]:
        raise ValueError(f"there is no index at {path}")
    state = _put(spark, path, state, segments=[*state["segments"], _segment(points, path, state)])
    while (again := _alike(state["segments"])):
        with settings(spark, {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}):
            merged = _segment(_union(spark, path, state, again), path, state)
        state = _put(spark, path, state, segments=[x for x in state["segments"] if x not in again] + [merged])
        _remove(spark, path, again)


def _alike(segments: list[dict]) -> list[dict]:
    classes: dict[int, list[dict]] = {}
    for x in segments:
        n, k = x["points"], 0
        while n >= MERGED:
            n, k = n // MERGED, k + 1
        classes.setdefault(k, []).append(x)
    return next((x for _, x in sorted(classes.items()) if len(x) >= MERGED), [])


def _remove(spark: SparkSession, path: str, segments: list[dict]) -> None:
    for x in segments:
        remove(spark, f"{path}/{x['at']}")


def _open(spark: SparkSession, path: str, state: dict, segment: dict) -> DataFrame:
    table, by = named(spark, f"index_{uuid.uuid4().hex[:12]}"), state["by"]
    columns = ", ".join(f"`{c}` {kind}" for c, kind in state["columns"])
    folders = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in by)})" if by else ""
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {folders} CLUSTERED BY (id) SORTED BY (dim, value, id) INTO {state['buckets']} BUCKETS LOCATION '{path}/{segment['at']}/points'")
    if by:
        spark.catalog.recoverPartitions(table)
    return spark.table(table)


def _union(spark: SparkSession, path: str, state: dict, segments: list[dict]) -> DataFrame:
    at = [_open(spark, path, state, x) for x in segments]
    out = at[0]
    for x in at[1:]:
        out = out.unionByName(x)
    return out


def segments(spark: SparkSession, path: str) -> list[tuple[DataFrame, DataFrame]]:
    """(points, bounds) of each; points are bucketed by id."""
    state = _state(spark, path)
    return [(_open(spark, path, state, x), spark.read.parquet(f"{path}/{x['at']}/bounds")) for x in state["segments"]]


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """All points."""
    state = _state(spark, path)
    if not state["segments"]:
        raise ValueError(f"there is no index at {path}")
    return _union(spark, path, state, state["segments"])


def load_bounds(spark: SparkSession, path: str) -> DataFrame:
    """(dim, least, most, n_values, n_points), as noted; of several segments, which may share values, counted again."""
    each = segments(spark, path)
    return each[0][1] if len(each) == 1 else bounds(load_index(spark, path))


def islands(preds: DataFrame, most: int = RANGES) -> DataFrame:
    """(dim, lo, up): at most so many ranges a dim that hold all of the predicates'; they are parted at the largest gaps."""
    order = Window.partitionBy("dim").orderBy("lo", "up")
    at = preds.where("lo <= up").select("dim", "lo", "up").distinct()
    at = at.withColumn("gap", F.col("lo").cast("long") - F.max("up").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    cut = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc_nulls_first("gap"), "lo", "up")) <= most
    at = at.withColumn("cut", cut & (F.col("gap").isNull() | (F.col("gap") > 1)))
    at = at.withColumn("island", F.sum(F.col("cut").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy("dim", "island").agg(F.min("lo").alias("lo"), F.max("up").alias("up")).drop("island")


def reach(preds: DataFrame) -> Column:
    """A filter of points that predicates may match, which reaches a scan: few ranges for each dim, of DIMS dims at most."""
    dims: dict[int, list[Column]] = {}
    for r in islands(preds).limit(RANGES * DIMS + 1).collect():
        dims.setdefault(r["dim"], []).append(F.col("value").between(r["lo"], r["up"]))
    if len(dims) > DIMS:
        return F.lit(True)
    return reduce(or_, ((F.col("dim") == dim) & reduce(or_, ranges) for dim, ranges in dims.items()), F.lit(False))


def reached(found: DataFrame, preds: DataFrame) -> bool:
    """Whether bounds (dim, least, most) meet any of the predicates."""
    return not preds.join(F.broadcast(found), "dim").where("lo <= most AND up >= least").isEmpty()  # a row for each dim


def save_results(top: DataFrame, path: str) -> None:
    """Lines of id,count in the order of queries and ranks."""
    top.orderBy("qid", "rnk").select(F.concat_ws(",", "id", "cnt").alias("value")).write.mode("overwrite").text(path)
