"""Encodings: rows of values become points (id, dim, value), one for each value to be matched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import grams

#: Occurrences of a gram in one row from this one on count as one.
OCCURRENCES = 63


def dealt(df: DataFrame, id_col: str = "id") -> DataFrame:
    """df (rows or points) dealt over tasks by id, so that what is counted by id needs no further shuffle.

    There are as many tasks as cores at least: rows are few where queries are many.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), id_col)


def vector_points(rows: DataFrame, id_col: str = "id", values_col: str = "values") -> DataFrame:
    """The place of a value is its dim."""
    return rows.select(F.col(id_col).alias("id"), F.posexplode(values_col).alias("dim", "value"))


def column_points(df: DataFrame, id_col: str, columns: dict[str, Column] | list[str], by_id: bool = False) -> DataFrame:
    """Columns of a table are its dims, in order. Null values match nothing and are left out. by_id: rows are dealt by id."""
    named = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    rows = df.select(F.col(id_col).alias("id"), F.array(*(c.cast("int") for c in named.values())).alias("values"))
    return vector_points(dealt(rows) if by_id else rows).where("value IS NOT NULL")


def _runs(rows: DataFrame) -> DataFrame:
    """rows, with sorted values v, and the places where a new value begins, at."""
    return rows.withColumn("at", F.filter(F.transform("v", lambda x, k: F.when((k == 0) | ~x.eqNullSafe(F.get("v", k - 1)), k)), lambda k: k.isNotNull()))


def _length(k: Column, j: Column) -> Column:
    """Of the j-th of _runs, which begins at k."""
    return F.coalesce(F.get("at", j + 1), F.size("v")) - k


def bag_points(rows: DataFrame, id_col: str = "id", values_col: str = "values") -> DataFrame:
    """All tokens are in dim 0, with n, how often the row has each. They are counted within the row, without a shuffle."""
    at = _runs(rows.select(F.col(id_col).alias("id"), F.array_sort(values_col).alias("v")))
    runs = F.transform("at", lambda k, j: F.struct(F.get("v", k).alias("value"), _length(k, j).cast("long").alias("n")))
    return at.select("id", F.lit(0).alias("dim"), F.inline(runs)).where("value IS NOT NULL")


def position_points(rows: DataFrame, id_col: str = "id", values_col: str = "values") -> DataFrame:
    """For subsequences: tokens with their place, pos, in the row."""
    return rows.select(F.col(id_col).alias("id"), F.lit(0).alias("dim"), F.posexplode(values_col).alias("pos", "value"))


def value_bounds(rows: DataFrame, values_col: str = "values") -> DataFrame:
    """One row: the least and greatest of all values."""
    return rows.agg(F.min(F.array_min(values_col)).alias("least"), F.max(F.array_max(values_col)).alias("most"))


def _numbered(rows: DataFrame, n: int) -> DataFrame:
    """(id, runs): of each row an array of its runs of n values, each with how many equal ones are before it: (value, dim)."""
    # Empty rows are left out by what they have: a look at the runs would be worked out again for each value, ahead of them.
    at = _runs(rows.where(F.size("values") > 0).select("id", F.array_sort(grams(F.col("values"), n)).alias("v")))
    each = F.transform("at", lambda k, j: F.transform(F.sequence(F.lit(0), _length(k, j) - 1), lambda i: F.struct(F.get("v", k).alias("value"), i.alias("dim"))))
    return at.select("id", F.flatten(each).alias("runs"))


def _occurrences(rows: DataFrame, n: int) -> DataFrame:
    """(id, value, dim): each run of n values, and how many equal ones its row has before it. Counted within the row."""
    return _numbered(rows, n).select("id", F.inline("runs"))


def gram_points(rows: DataFrame, n: int = 3, id_col: str = "id", values_col: str = "values", most: int = OCCURRENCES) -> DataFrame:
    """For sequences: each run of n values, with the number of its occurrence in the row (at most `most`) as dim.

    Two rows then match as often as they have runs in common, each as often as both have it.
    """
    at = _occurrences(rows.select(F.col(id_col).alias("id"), F.col(values_col).alias("values")), n)
    return at.select("id", F.least("dim", F.lit(most)).alias("dim"), "value")


def _within(rows: DataFrame, data: DataFrame, id_col: str = "id", values_col: str = "values") -> DataFrame:
    """(id, values) without values beyond the data's bounds."""
    b = value_bounds(data, values_col).first()  # one row
    return rows.select(F.col(id_col).alias("id"), F.filter(values_col, lambda v: v.between(F.lit(b["least"]), F.lit(b["most"]))).alias("values"))


def gram_predicates(rows: DataFrame, data: DataFrame, n: int = 3, id_col: str = "id", values_col: str = "values", most: int = OCCURRENCES) -> DataFrame:
    """Queries for gram_points of data: values beyond the data's bounds are left out, then runs are made; occurrences above
    `most` are dropped."""
    at = _occurrences(_within(rows, data, id_col, values_col), n).where(F.col("dim") <= most)
    return at.select(F.col("id").alias("qid"), F.lit(0).alias("ord"), "dim", F.col("value").alias("lo"), F.col("value").alias("up"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("selectivity"))


def gram_tokens(rows: DataFrame, n: int = 3, most: int = OCCURRENCES, data: DataFrame | None = None) -> DataFrame:
    """(id, values): gram_points as a row's bag of texts, in which a run stands with its dim; with data, gram_predicates of rows."""
    runs = F.col("runs") if data is None else F.filter("runs", lambda x: x["dim"] <= most)
    token = lambda x: F.concat(F.to_json(x["value"]), F.lit(":"), F.least(x["dim"], F.lit(most)).cast("string"))
    return _numbered(rows.select("id", "values") if data is None else _within(rows, data), n).select("id", F.transform(runs, token).alias("values"))


def append(*tables: DataFrame) -> DataFrame:
    """The points of several tables, each with its own dims."""
    return reduce(DataFrame.unionByName, tables)


def chunk(points: DataFrame, size: int) -> DataFrame:
    """points with the number of the chunk of `size` ids to which each belongs."""
    return points.withColumn("chunk", F.floor(F.col("id") / size).cast("long"))
