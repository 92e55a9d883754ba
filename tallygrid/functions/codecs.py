"""Lossless codecs for lists of unsigned 32-bit integers, by name, and as column functions.

A codec turns a list into a list of words. They change sizes, never results; Parquet's own encodings do this work for
stored tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Words = np.ndarray


class Codec(NamedTuple):
    encode: Callable[[Words], Words]
    decode: Callable[[Words], Words]


def _u32(x) -> Words:
    return np.asarray(x, np.int64).astype(np.uint32) if not isinstance(x, np.ndarray) or x.dtype != np.uint32 else x


def _delta(x: Words) -> Words:
    return np.diff(_u32(x), prepend=np.uint32(0)).astype(np.uint32)


def _undelta(x: Words) -> Words:
    return np.cumsum(_u32(x), dtype=np.uint64).astype(np.uint32)


def _widths(minis: Words) -> np.ndarray:
    """Bits of the largest value of each row."""
    return np.frexp(minis.max(1).astype(np.float64))[1].astype(np.int64)


def _pack(x: Words) -> Words:
    """[length]; for each 128 values a word of four widths, then the values of each 32 in as many words as their width."""
    x = _u32(x)
    n_blocks = -(-len(x) // 128)
    minis = np.zeros(n_blocks * 128, np.uint32)
    minis[: len(x)] = x
    minis = minis.reshape(-1, 32)
    width = _widths(minis)
    # A block begins with its widths; what holds no value has width 0.
    at = np.cumsum(width) - width + 1 + 1 + np.arange(len(minis)) // 4
    out = np.zeros(1 + n_blocks + int(width.sum()), np.uint32)
    out[0] = len(x)
    out[at[::4] - 1] = (width.reshape(-1, 4) << np.array([24, 16, 8, 0])).sum(1)
    for w in np.unique(width[width > 0]).tolist():
        own = width == w
        bits = (minis[own][:, :, None] >> np.arange(w, dtype=np.uint32) & np.uint32(1)).astype(np.uint8)
        words = np.packbits(bits.reshape(-1, 32 * w), axis=1, bitorder="little").view("<u4")
        out[at[own][:, None] + np.arange(w)] = words
    return out


def _unpack(x: Words) -> Words:
    x = _u32(x)
    n, place = int(x[0]), 1
    n_blocks = -(-n // 128)
    width, at = np.zeros(4 * n_blocks, np.int64), np.zeros(4 * n_blocks, np.int64)
    for k in range(n_blocks):  # a block's place follows from the widths before it
        head = int(x[place])
        place += 1
        for j in range(4):
            width[4 * k + j], at[4 * k + j] = head >> 24 - 8 * j & 0xFF, place
            place += int(width[4 * k + j])
    out = np.zeros((4 * n_blocks, 32), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = width == w
        words = np.ascontiguousarray(x[at[own][:, None] + np.arange(w)].astype("<u4"))
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").reshape(-1, 32, w)
        out[own] = (bits.astype(np.uint64) << np.arange(w, dtype=np.uint64)).sum(2).astype(np.uint32)
    return out.reshape(-1)[:n]


def _varint(x: Words) -> Words:
    """Seven bits a byte, the least first; the last byte of a value has the high bit. Filled with zeros to whole words."""
    x = _u32(x)
    size = 1 + sum((x >= np.uint32(1 << 7 * k)).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(x) else 0) - np.repeat(ends - size, size)
    out = (np.repeat(x, size) >> (7 * place).astype(np.uint32) & np.uint32(127)).astype(np.uint8)
    out[ends - 1] |= 128
    return np.concatenate([out, np.zeros(-len(out) % 4, np.uint8)]).view("<u4").astype(np.uint32)


def _unvarint(x: Words) -> Words:
    raw = _u32(x).astype("<u4").view(np.uint8)
    ends = np.flatnonzero(raw & 128) + 1
    if not len(ends):
        return np.zeros(0, np.uint32)
    raw, begins = raw[: ends[-1]], np.r_[0, ends[:-1]]
    place = np.arange(len(raw)) - np.repeat(begins, ends - begins)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begins).astype(np.uint32)


def serial(first: Codec, then: Codec) -> Codec:
    return Codec(lambda x: then.encode(first.encode(x)), lambda x: first.decode(then.decode(x)))


def composite(most: Codec, rest: Codec) -> Codec:
    """[words of the first]; the first codec has the longest part whose length 8 divides, the other what is left."""

    def encode(x: Words) -> Words:
        k = len(x) // 8 * 8
        a, b = most.encode(_u32(x)[:k]), rest.encode(_u32(x)[k:])
        return np.concatenate([np.array([len(a)], np.uint32), a, b])

    def decode(x: Words) -> Words:
        k = int(x[0])
        return np.concatenate([most.decode(_u32(x)[1 : 1 + k]), rest.decode(_u32(x)[1 + k :])])

    return Codec(encode, decode)


COPY, DELTA, BP32, VARINT = Codec(_u32, _u32), Codec(_delta, _undelta), Codec(_pack, _unpack), Codec(_varint, _unvarint)

CODECS: dict[str, Codec] = {
    "no": COPY, "copy": COPY, "delta": DELTA, "bp32": BP32, "varint": VARINT,
    "bp32-copy": composite(BP32, COPY), "bp32-varint": composite(BP32, VARINT),
    "copy-copy": serial(COPY, COPY), "delta-copy": serial(DELTA, COPY), "delta-delta": serial(DELTA, DELTA),
    "delta-varint": serial(DELTA, VARINT), "delta-bp32": serial(DELTA, BP32),
    "delta-bp32-copy": serial(DELTA, composite(BP32, COPY)), "delta-bp32-varint": serial(DELTA, composite(BP32, VARINT)),
}
CODECS |= {"light": CODECS["bp32"], "middle": CODECS["delta-bp32"], "heavy": CODECS["delta-bp32-varint"]}


def codec(name: str) -> Codec:
    """By name; an unknown name is no compression."""
    return CODECS.get(name.lower(), COPY)


def encode(values: Column, name: str) -> Column:
    """Workers need this package (see workers.importable), as for all functions here."""
    one = codec(name)

    @F.pandas_udf("array<bigint>")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else one.encode(_u32(x)).astype(np.int64))

    return run(values)


def decode(words: Column, name: str) -> Column:
    one = codec(name)

    @F.pandas_udf("array<bigint>")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else one.decode(_u32(x)).astype(np.int64))

    return run(words)


def all_sizes(values: Column, names: Sequence[str]) -> Column:
    """The words that each of these codecs makes of a list, in order."""
    own = [codec(n) for n in names]

    @F.pandas_udf("array<bigint>")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else [len(c.encode(_u32(x))) for c in own])

    return run(values)


def all_round_trips(values: Column, names: Sequence[str]) -> Column:
    """Whether a list comes back as it was, for each of these codecs, in order."""
    own = [codec(n) for n in names]

    @F.pandas_udf("array<boolean>")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else [np.array_equal(c.decode(c.encode(y)), y) for y in [_u32(x)] for c in own])

    return run(values)


def bits_per_int(values: Column, words: Column) -> Column:
    return 32.0 * F.size(words) / F.size(values)
