"""What the operators of this subpackage share: work tables in the cluster's shared folder, A-Z folding and words."""

from __future__ import annotations

import string
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import importable
from ..workspace import materialize, named, put, shared_root, workspace

__all__ = ["importable", "materialize", "named", "put", "shared_root", "workspace"]

#: Everything that separates words: ASCII but for digits and lower-case letters (upper-case ones are folded before).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def fold(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty. For pure ASCII, lower() is the same and faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """The words of a text: runs of digits, letters a-z (A-Z folded) and non-ASCII characters. Null has none."""
    return F.array_remove(F.split(fold(text), NOT_WORD), "")


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; looks no further than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many (narrow) rows; otherwise left to a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def staying(df: DataFrame, keys: list[Column], pairs: DataFrame, rows: int) -> DataFrame:
    """The rows of df that stay, with all their columns: of the n rows with the same keys, m.

    pairs has a row for each value of keys (nulls are values), its columns in their order, and then n and m. m is 0, 1 or
    n; where it is 1 any one row stays. Keys with m < n are broadcast if they are at most so many. Only rows whose keys
    repeat, and of which one stays, are shuffled with their texts, after all but one in each task are dropped.
    """
    own = [unused(df, f"gone_{k}") for k in range(len(keys))]
    one = unused(df, "gone_but_one")
    *names, n, m = pairs.columns
    gone = pairs.where(F.col(m) < F.col(n)).select(*(F.col(c).alias(o) for c, o in zip(names, own, strict=True)), (F.col(m) > 0).alias(one))
    gone = materialize(gone, "gone")
    same = reduce(and_, (k.eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)))
    out = df.join(broadcast_if_small(gone, rows), same, "left_anti")
    repeated = gone.where(one)
    if repeated.isEmpty():
        return out
    again = df.join(broadcast_if_small(repeated, rows), same).dropDuplicates(own)
    return out.unionByName(again.select(*df.columns))
