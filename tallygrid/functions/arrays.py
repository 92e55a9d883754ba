"""Column functions on arrays of integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(text: Column) -> Column:
    """The integer with which a text begins, after white space; else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def ground(values: Column, least: Column) -> Column:
    return F.transform(values, lambda v: v - least)


def grams(values: Column, n: int) -> Column:
    """The runs of n values; fewer values are one run, filled up with the first; none give none."""
    size = F.size(values)
    padded = F.concat(values, F.array_repeat(F.get(values, F.lit(0)), F.greatest(F.lit(0), F.lit(n) - size)))
    runs = F.transform(F.sequence(F.lit(1), F.size(padded) - n + 1), lambda k: F.slice(padded, k, n))
    return F.when(size > 0, runs).otherwise(F.array().cast("array<array<int>>"))


def gram_code(gram: Column, base: Column) -> Column:
    """A run as one number, by places of the base."""
    return F.aggregate(gram, F.lit(0).cast("long"), lambda a, v: a * base + v)


def delta(values: Column) -> Column:
    """Differences to the value before, the first to 0, modulo 2^32."""
    before = lambda k: F.when(k > 0, F.get(values, k - 1)).otherwise(F.lit(0)).cast("long")
    return F.transform(values, lambda v, k: F.pmod(v.cast("long") - before(k), F.lit(1 << 32)))


def undelta(values: Column) -> Column:
    """The inverse of delta."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, d: Column) -> Column:
        at = F.pmod(s["at"] + d, F.lit(1 << 32))
        return F.struct(at.alias("at"), F.concat(s["out"], F.array(at)).alias("out"))

    return F.aggregate(values, start, step)["out"]


def pack_id(row: Column, place: Column, bits: int) -> Column:
    return F.shiftleft(row.cast("long"), bits).bitwiseOR(place.cast("long"))


def unpack_id(packed: Column, bits: int) -> tuple[Column, Column]:
    """(row, place in it)."""
    return F.shiftright(packed, bits), packed.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def bits_for(length: int) -> int:
    """The least s with 2^s >= length."""
    return max(0, (length - 1).bit_length())
