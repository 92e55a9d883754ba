"""Queries as predicates (qid, ord, dim, lo, up, weight, selectivity): a point matches that has the dim and lies within."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import importable
from ..workspace import materialize
from .match import _small, hinted, met, planned
from .stats import prefix_sums

#: Distinct values, of all dims, whose counts are sent to every task; more stay where they are, and predicates grow by passes
#: over them, each of which tries so many sizes of a range.
HISTOGRAM_ROWS, PROBES = 1_000_000, 64
COLUMNS = ["qid", "ord", "dim", "lo", "up", "weight", "selectivity"]


def _made(df: DataFrame, ord_: Column, dim: Column, lo: Column, up: Column) -> DataFrame:
    return df.select("qid", ord_.cast("int").alias("ord"), dim.cast("int").alias("dim"), lo.alias("lo"), up.alias("up"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("selectivity"))


def radius_predicates(rows: DataFrame, radius: int = 0, dims: int | None = None, id_col: str = "id", values_col: str = "values") -> DataFrame:
    """For vectors: each value, give or take radius; only the first `dims` values where that is given."""
    at = rows.select(F.col(id_col).alias("qid"), F.posexplode(values_col).alias("pos", "value"))
    at = at.where(F.col("pos") < dims) if dims is not None else at
    return _made(at, F.col("pos"), F.col("pos"), F.col("value") - radius, F.col("value") + radius) if radius else _made(at, F.col("pos"), F.col("pos"), F.col("value"), F.col("value"))


def bag_predicates(rows: DataFrame, radius: int = 0, id_col: str = "id", values_col: str = "values") -> DataFrame:
    """For bags and subsequences: all tokens in dim 0, repeated ones too; ord is the place in the query."""
    at = rows.select(F.col(id_col).alias("qid"), F.posexplode(values_col).alias("pos", "value"))
    lo, up = (F.col("value") - radius, F.col("value") + radius) if radius else (F.col("value"), F.col("value"))
    return _made(at, F.col("pos"), F.lit(0), lo, up)


def as_predicates(points: DataFrame) -> DataFrame:
    """Points as queries for themselves."""
    return _made(points.withColumnRenamed("id", "qid"), F.col("dim"), F.col("dim"), F.col("value"), F.col("value"))


def first_queries(preds: DataFrame, n: int) -> DataFrame:
    """The predicates of the first n queries by qid."""
    ids = preds.select("qid").distinct().orderBy("qid").limit(n)
    return preds.join(hinted(ids), "qid", "left_semi")


def valid(preds: DataFrame, dims: int) -> DataFrame:
    """Without those whose dim doesn't exist or that are empty."""
    return preds.where((F.col("dim") >= 0) & (F.col("dim") < dims) & (F.col("lo") <= F.col("up")))


def multirange(attributes: DataFrame, points: DataFrame, n: int, rows: int | None = None) -> DataFrame:
    """From long form (qid, dim, value, selectivity, weight): points in the first n queries, widened by selectivity."""
    at = attributes.select("qid", F.col("dim").alias("ord"), "dim", F.col("value").alias("lo"), F.col("value").alias("up"), F.col("weight").cast("double").alias("weight"), F.col("selectivity").cast("double").alias("selectivity"))
    return widen(first_queries(at, n), points, rows=rows)


def clamp(preds: DataFrame, bounds: DataFrame) -> DataFrame:
    """Ranges cut to what a dim (dim, least, most) has; those outside are dropped. bounds has one row for each dim."""
    at = preds.join(bounds, "dim").withColumn("lo", F.greatest("lo", "least")).withColumn("up", F.least("up", "most"))
    return at.where("lo <= up").select(*COLUMNS)


def widened(lo: np.ndarray, up: np.ndarray, threshold: np.ndarray, values: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of one dim, each grown step by step until it covers its threshold of points, or all.

    values: the dim's distinct values, sorted; total: points up to each. A step goes one down, then one up. Where there
    is nothing further down, the lower end falls to 0 without steps up, and then only the upper end moves. The upper end
    stays within the values.
    """
    least, most, sums = int(values[0]), int(values[-1]), np.r_[0, total]

    def reached(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sums[np.searchsorted(values, b, "right")] - sums[np.searchsorted(values, a - 1, "right")] >= threshold

    def first(good: Callable[[np.ndarray], np.ndarray], n: np.ndarray) -> np.ndarray:
        """For each the least k in 1..n with good(k), which stays true; n if none."""
        a, b = np.ones_like(n), n
        while (a < b).any():
            mid = (a + b) // 2
            found = good(mid)
            a, b = np.where(found | (a >= b), a, mid + 1), np.where(found, np.minimum(mid, b), b)
        return b

    short = ~reached(lo, up)
    down = short & (lo > 0)
    lo = np.where(down & (lo > most + 1), max(most + 1, 0), lo)  # nothing in between
    steps = np.where(down, lo - max(least, 0), 0)
    # The upper end moves along unless it is at the greatest value, beyond it, or apart from all values.
    top = lambda k: np.where(up >= least - 1, np.maximum(up, np.minimum(up + k, most)), up)
    k = first(lambda k: reached(lo - k, top(k)), np.maximum(steps, 1))
    lo, up = np.where(steps > 0, lo - k, lo), np.where(steps > 0, top(k), up)
    short &= ~reached(lo, up)
    lo = np.where(down & short, 0, lo)
    k = first(lambda k: reached(lo, up + k), np.maximum(most - up, 1))
    return lo, np.where(short & (least - 1 <= up) & (up < most), up + k, up)


def widen(preds: DataFrame, points: DataFrame, selectivity: float = 0.0, rows: int | None = None) -> DataFrame:
    """Ranges grown until each covers its share of all rows: its own selectivity, else the one given; 0 leaves it.

    rows: the number of rows, if known; otherwise the distinct ids of the points are counted.
    """
    importable(points.sparkSession)
    counts = materialize(points.groupBy("dim", "value").count(), "histogram")
    n = points.agg(F.countDistinct("id")).first()[0] or 0 if rows is None else rows
    own = preds.withColumn("share", F.when(F.col("selectivity") > 0, F.col("selectivity")).otherwise(F.lit(float(selectivity))))
    own = own.select(*COLUMNS, "share")
    kinds = dict(preds.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in COLUMNS)

    def grown(p: pd.DataFrame, values: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        ask = (p["share"] > 0).to_numpy() & bool(len(values))
        lo, up = p["lo"].to_numpy(np.int64), p["up"].to_numpy(np.int64)
        if ask.any():
            need = np.ceil(p["share"].to_numpy()[ask] * n).astype(np.int64)
            lo, up = lo.copy(), up.copy()
            lo[ask], up[ask] = widened(lo[ask], up[ask], need, values, total)
        return p.assign(lo=lo, up=up)[COLUMNS]

    if _small(counts, HISTOGRAM_ROWS):
        h = counts.orderBy("dim", "value").toPandas()
        tables = {dim: (g["value"].to_numpy(np.int64), g["count"].cumsum().to_numpy()) for dim, g in h.groupby("dim")}

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                for dim, part in p.groupby("dim"):
                    yield grown(part, *tables[dim]) if dim in tables else part[COLUMNS]

        return own.mapInPandas(each, schema)
    return _widen_by_ranks(own, counts, n).select(*(F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS))


def _covered(asks: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, k, n): how many points each of the asks (key, k, dim, a, b) covers, of counts (dim, value, count).

    The ends of all ranges are sorted in among the values, by ranges of both, and take the sum of what stands before.
    """
    end = lambda at, sign: F.struct(at.cast("long").alias("value"), F.lit(sign).alias("sign"))
    ends = asks.select("key", "k", "dim", F.inline(F.array(end(F.col("a") - 1, -1), end(F.col("b"), 1))))
    rows = counts.select("dim", F.col("value").cast("long").alias("value"), F.lit(0).alias("sign"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("k"), F.col("count").alias("n"))
    rows = rows.unionByName(ends.withColumn("n", F.lit(0).cast("long"))).withColumn("last", F.col("sign") != 0)
    sums = prefix_sums(rows, ["dim", "value", "last", "key", "k"], "n").where("last")
    return sums.groupBy("key", "k").agg(F.sum(F.col("sign") * F.col("before")).alias("n"))


def _least(asked: DataFrame, counts: DataFrame, a: Callable[[Column], Column], b: Callable[[Column], Column]) -> DataFrame:
    """asked with k, the least in 1..most_k for which a(k) to b(k) covers what is needed; most_k if none does.

    A pass tries PROBES values of k for each row and leaves one gap between them.
    """
    at = asked.withColumns({"x": F.lit(1).cast("long"), "k": F.col("most_k")})
    while not (open_ := at.where("x < k")).isEmpty():
        step = F.ceil((F.col("k") - F.col("x")) / PROBES)
        tries = open_.withColumn("try", F.explode(F.sequence(F.col("x"), F.col("k") - 1, step)))
        n = _covered(tries.select("key", F.col("try").alias("k"), "dim", a(F.col("try")).alias("a"), b(F.col("try")).alias("b")), counts)
        told = n.join(at.select("key", "need"), "key").groupBy("key").agg(F.min(F.when(F.col("n") >= F.col("need"), F.col("k"))).alias("good"), F.max(F.when(F.col("n") < F.col("need"), F.col("k"))).alias("bad"))
        at = at.join(told, "key", "left").withColumns({"k": F.coalesce("good", "k"), "x": F.coalesce(F.col("bad") + 1, F.col("x"))}).drop("good", "bad")
        at = materialize(at, "growth")
    return at.drop("x")


def _widen_by_ranks(own: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """As widened does for a dim, for all predicates of all dims together, by passes over the sorted values; the values of no
    dim come together in one task."""
    b = counts.groupBy("dim").agg(F.min("value").cast("long").alias("least"), F.max("value").cast("long").alias("most"))
    at = own.withColumn("key", F.monotonically_increasing_id()).withColumns({"lo": F.col("lo").cast("long"), "up": F.col("up").cast("long"), "need": F.ceil(F.col("share") * n)})
    at = materialize(at.join(hinted(b), "dim", "left"), "growing")
    lo, up, least, most = (F.col(c) for c in ("lo", "up", "least", "most"))
    mine = lambda df, *more: df.select("key", "dim", "lo", "up", "least", "most", "need", *more)

    def short(df: DataFrame) -> DataFrame:
        got = _covered(df.select("key", F.lit(0).cast("long").alias("k"), "dim", lo.alias("a"), up.alias("b")), counts)
        return df.join(got.select("key", "n"), "key").where("n < need").drop("n")

    todo = materialize(short(mine(at.where((F.col("share") > 0) & least.isNotNull()))), "short")
    down = todo.where("lo > 0").withColumn("lo", F.when(lo > most + 1, F.greatest(most + 1, F.lit(0))).otherwise(lo))
    down = down.withColumn("most_k", lo - F.greatest(least, F.lit(0)))
    top = lambda k: F.when(up >= least - 1, F.greatest(up, F.least(up + k, most))).otherwise(up)
    moved = _least(down.where("most_k > 0"), counts, lambda k: lo - k, top)
    moved = mine(moved.withColumns({"lo": lo - F.col("k"), "up": top(F.col("k"))})).unionByName(mine(down.where("most_k <= 0")))
    moved = materialize(moved, "moved")
    rest = short(moved).withColumn("lo", F.lit(0).cast("long")).unionByName(mine(todo.where("lo <= 0")))
    rest = materialize(rest, "rest")
    higher = _least(rest.where((least - 1 <= up) & (up < most)).withColumn("most_k", most - up), counts, lambda k: lo, lambda k: up + k)
    ends = mine(higher.withColumn("up", up + F.col("k"))).unionByName(mine(rest.where(~((least - 1 <= up) & (up < most)))))
    new = lambda df, name: df.select("key", F.struct("lo", "up").alias(name))
    found = at.join(new(moved, "first"), "key", "left").join(new(ends, "second"), "key", "left")
    kept = F.coalesce("second", "first", F.struct("lo", "up"))
    return found.withColumns({"lo": kept["lo"], "up": kept["up"]})


def selectivity_of(preds: DataFrame, points: DataFrame) -> DataFrame:
    """preds with the number of points that each covers."""
    counts = points.groupBy("dim", "value").agg(F.count("*").alias("n"))
    ranges = preds.select("dim", "lo", "up").distinct()
    key = F.struct("dim", "lo", "up")
    asked, size = planned(ranges.select(key.alias("qid"), "dim", "lo", "up", F.lit(1).alias("w")))
    hit = met(counts, asked, [], size).groupBy("qid").agg(F.sum("n").alias("covered"))
    hit = hit.select("qid.dim", "qid.lo", "qid.up", "covered")
    return preds.join(hit, ["dim", "lo", "up"], "left").select(*COLUMNS, F.coalesce("covered", F.lit(0)).alias("covered"))


def clear_dim(preds: DataFrame, dim: int, qid: int | None = None) -> DataFrame:
    """Without the ranges in a dim, of all queries or of one."""
    gone = F.col("dim") == dim
    return preds.where(~(gone if qid is None else gone & (F.col("qid") == qid)))


def count_ranges(preds: DataFrame) -> DataFrame:
    """(qid, n_ranges, n_dims)."""
    return preds.groupBy("qid").agg(F.count("*").alias("n_ranges"), F.countDistinct("dim").alias("n_dims"))


def dump(preds: DataFrame) -> DataFrame:
    """A line for each range, as text: qid ord dim [lo, up] weight selectivity."""
    return preds.select("qid", F.format_string("%d %d %d [%d, %d] %.3f %.3f", *COLUMNS).alias("line"))

