"""Vectors compressed to codes: each part of a vector becomes the number of the nearest of a codebook's entries.

Everything is in integers, so that sums don't depend on how rows are dealt out. Which entry is nearest is found from coarse
to fine: the mean of a block of components and the norm of what is left without it bound a distance from below, as
|x - c|^2 >= n (mean x - mean c)^2 + (rest x - rest c)^2 for a block of n; blocks are the whole part, then its halves, and so
on. The entry with the least coarse bound gives a distance that the nearest can't exceed; entries whose bound does are left
out, and what survives all levels gets its exact distance.

Codebooks are learnt in rounds: tasks assign their parts and send a sum for each entry, which are added up to a row for each
entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, importable, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components stay below this in size, so that squares, summed over 4,096 components, fit 64 bits.
LARGEST = 1 << 24
#: Vectors whose distances are worked out at once.
TOGETHER = 4_096
#: Labels that are broadcast; more take a shuffled join.
LABEL_ROWS = 500_000

#: (part, entry, component)
Codebooks = np.ndarray


def _blocks(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (..., components): sums of each of n blocks, and the norms of what is left without the blocks' means."""
    at = x.reshape(*x.shape[:-1], n, x.shape[-1] // n).astype(np.float64)
    sums = at.sum(-1)
    return sums, np.sqrt(np.maximum((at * at).sum(-1) - sums * sums / at.shape[-1], 0))


def _levels(components: int) -> list[int]:
    """Numbers of blocks, from one on, each twice the one before, while blocks have two components or more."""
    out = [1]
    while components % (2 * out[-1]) == 0 and components // out[-1] >= 4:
        out.append(2 * out[-1])
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row (int64) the nearest row of entries (ties: the first), its squared distance, and how many exact distances
    that took."""
    rows, width = np.arange(len(x)), x.shape[1]
    for level in _levels(width):
        (a, u), (b, v) = _blocks(x, level), _blocks(entries, level)
        # All bounds of a level at once, block by block: that costs less than to pick those of entries still in question.
        bound = sum(np.subtract.outer(a[:, j], b[:, j]) ** 2 * (level / width) + np.subtract.outer(u[:, j], v[:, j]) ** 2 for j in range(level))
        if level == 1:
            guess = bound.argmin(1)
            # A norm errs by 2e-8 times its vector's, as a difference of two squares does, and its square by twice that.
            squares, largest = (a * a / width + u * u)[:, 0], (b * b / width + v * v).max(initial=0)
            most = (((x - entries[guess]) ** 2).sum(1) + 1e-7 * (squares + largest) + 1)[:, None]
            alive = bound <= most
        else:
            alive &= bound <= most
    alive[rows, guess] = True
    r, k = np.nonzero(alive)
    exact = np.full(alive.shape, np.iinfo(np.int64).max)
    apart = x[r] - entries[k]
    exact[r, k] = np.einsum("ij,ij->i", apart, apart)
    best = exact.argmin(1)
    return best, exact[rows, best], len(x) + len(r)


def _assigned(packed: list[bytes], books: Codebooks) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors by part, numbers of the nearest entries, errors), of some vectors at a time."""
    parts = len(books)
    for lo in range(0, len(packed), TOGETHER):
        x = np.frombuffer(b"".join(packed[lo : lo + TOGETHER]), "<i4").reshape(-1, parts, books.shape[2]).astype(np.int64)
        found = [nearest(np.ascontiguousarray(x[:, p]), books[p])[:2] for p in range(parts)]
        yield x, np.stack([k for k, _ in found], 1), np.stack([e for _, e in found], 1)


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, components: int | None = None) -> DataFrame:
    """(all columns but vector_col, with id_col; q: the components as integers, packed), written to the shared folder.

    Component x becomes floor(scale x). Left out are null vectors, those that hold null, NaN or infinity, and those of
    another length than `components`; if that isn't given, than the vector with the least id has (of equal ids the longest;
    null ids come last). An integer component of 2^24 or more in size is an error.
    """
    importable(rows.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    at = rows.where(v.isNotNull() & finite & (F.size(v) > 0))
    if components is None:
        first = at.select(F.col(id_col).alias("id"), F.size(v).alias("n")).orderBy(F.asc_nulls_last("id"), F.desc("n")).first()
        components = first["n"] if first else 1
    whole = F.transform(v, lambda x: F.floor(x * scale))
    large = F.exists(v, lambda x: (x * scale >= LARGEST) | (x * scale < -LARGEST))
    told = F.raise_error(F.concat(F.lit(f"components times {scale} must lie between {-LARGEST} and {LARGEST}: "), F.col(id_col).cast("string")))
    q = F.when(large, told.cast("array<bigint>")).otherwise(whole)
    rest = [c for c in rows.columns if c != vector_col]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(len(rest)).flatten().to_numpy().astype("<i4").reshape(len(batch), components)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x.tobytes() for x in flat], pa.binary())], [f"c{k}" for k in range(len(rest))] + ["q"])

    kinds = dict(rows.dtypes)
    names = [F.col(c).alias(f"c{k}") for k, c in enumerate(rest)]
    made = at.where(F.size(v) == components).select(*names, q.alias("q")).mapInArrow(pack, ", ".join([*(f"c{k} {kinds[c]}" for k, c in enumerate(rest)), "q binary"]))
    return materialize(made.toDF(*rest, "q"), "vectors")


def fit(packed: DataFrame, id_col: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks (part, entry, component) of vectors(): `parts` equal consecutive parts of each vector, and for each part
    `entries` entries.

    An entry starts as that part of one of the vectors with the least ids (null ids come last, equal ids in the order of
    their packed components), in their order; there are fewer entries if there are fewer vectors. A round assigns every part
    to its nearest entry (ties: the first), and replaces each entry by the floored means of its parts' components; an entry
    without any stays.
    """
    first = packed.select(F.col(id_col).alias("id"), "q").orderBy(F.asc_nulls_last("id"), "q").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    width = len(first[0]["q"]) // 4
    if width % parts:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    books = np.stack([np.frombuffer(r["q"], "<i4").reshape(parts, -1) for r in first], 1).astype(np.int64)
    for _ in range(rounds):
        books = _moved(packed, books)
    return books


def _moved(packed: DataFrame, books: Codebooks) -> Codebooks:
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, often = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for x, k, _ in _assigned(batch.column(0).to_pylist(), books):
                at = (k + np.arange(parts) * entries).reshape(-1)
                flat = x.reshape(-1, width)
                for j in range(width):  # exact in doubles: at most 2^12 numbers below 2^24 each
                    total[:, j] += np.bincount(at, flat[:, j], len(total)).astype(np.int64)
                often += np.bincount(at, minlength=len(often))
        own = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(often[own], pa.int64()), *(pa.array(total[own, j], pa.int64()) for j in range(width))], ["entry", "n", *(f"s{j}" for j in range(width))])

    names = ["n", *(f"s{j}" for j in range(width))]
    each = packed.select("q").mapInArrow(sums, ", ".join(["entry int", *(f"{c} long" for c in names)]))
    # Of parts times entries rows; decimals, as sums of all rows may not fit 64 bits.
    out = books.reshape(-1, width).copy()
    for r in each.groupBy("entry").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names)).collect():
        out[r["entry"]] = [int(r[f"s{j}"]) // int(r["n"]) for j in range(width)]
    return out.reshape(books.shape)


def encode(packed: DataFrame, books: Codebooks) -> DataFrame:
    """vectors() with code (an entry's number, in two hexadecimal digits, for each part) and error (squared distances, summed
    over parts) in place of q."""
    if books.size and books.shape[1] > 256:
        raise ValueError("a code has two hexadecimal digits, for 256 entries at most")
    rest = [c for c in packed.columns if c != "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [*_assigned(batch.column(len(rest)).to_pylist(), books)]
            code = [k.astype(np.uint8).tobytes().hex() for _, ks, _ in found for k in ks]
            error = np.concatenate([e.sum(1) for _, _, e in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(error, pa.int64())], [f"c{k}" for k in range(len(rest))] + ["code", "error"])

    kinds = dict(packed.dtypes)
    at = packed.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(rest)), "q")
    return at.mapInArrow(run, ", ".join([*(f"c{k} {kinds[c]}" for k, c in enumerate(rest)), "code string", "error long"])).toDF(*rest, "code", "error")


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE, into: str = "vector") -> DataFrame:
    """codes (with a column code) and the vectors, as doubles, that their entries make."""
    each = F.array(*(F.array(*(F.array(*(F.lit(float(x) / scale) for x in entry)) for entry in part)) for part in books))
    number = lambda p: F.conv(F.substring("code", F.lit(2) * p + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn(into, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.get(F.get(each, p), number(p)))))


def digest(books: Codebooks) -> str:
    """SHA-256, in hexadecimal digits, of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) for each vector that vectors() keeps: see fit and encode.

    label_error sums the errors of rows with the same label; null is a label. Rows that repeat an id are rows of their own.
    Other columns are ignored; a table without such vectors gives no rows.
    """
    packed = vectors(rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")), "id", "v", scale)
    books = fit(packed, "id", parts, entries, rounds)
    found = materialize(encode(packed, books), "codes")
    sums = materialize(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    both = found.join(broadcast_if_small(sums, LABEL_ROWS), F.col("label").eqNullSafe(F.col("of")))
    return both.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
