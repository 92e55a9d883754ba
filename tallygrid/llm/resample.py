"""Importance resampling towards a target's distribution of words and runs of words, by hashed features.

A task keeps a trie of the words that it reads: a node is a run of words, and holds how often the run was met and the CRC
of its text so far, from which a child's follows by its own word alone. Nodes' counts are added up by bucket (the CRC modulo
the number of buckets), which a task does at its end, or when its trie is full; totals of all tasks are merged. From the
totals of the documents and of the target follows a gain for each bucket. Documents are then scored along the same paths, in
tries whose nodes have gains in place of counts.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import prefix_sums
from .blocks import tidied, tidy
from .shared import importable, materialize, unused

BUCKETS, RUN = 10_000, 2
#: Documents of fewer words are not drawn; share of the others, in hundredths; seed of the draw.
LEAST_WORDS, SHARE, SEED = 20, 25, 7
#: Nodes after which a task begins a new trie; bytes of text that are walked at once.
NODES, PIECE = 400_000, 1 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


@functools.lru_cache(256)
def _shift(n: int) -> np.ndarray:
    """(4, 256): what n more bytes make of a CRC state, by its bytes; CRC-32 is linear, so that a text's follows from those
    of its two parts."""
    if n == 0:
        return np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    zeros, bits = bytes(n), np.array([1 << k for k in range(8)], np.uint32)
    alone = zlib.crc32(zeros)
    out = np.zeros((4, 256), np.uint32)
    for j in range(4):
        for k in range(8):
            one = np.uint32(zlib.crc32(zeros, 1 << 8 * j + k) ^ alone)
            out[j] ^= np.where(np.arange(256, dtype=np.uint32) & bits[k], one, np.uint32(0))
    return out


class _Numbers(dict):
    """Numbers words as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Trie:
    """Runs of at most `run` words. value: of each node, its count, or its bucket's gain where gains are given."""

    def __init__(self, buckets: int, run: int, gains: np.ndarray | None = None):
        self.buckets, self.run, self.gains = buckets, run, gains
        self.totals = np.zeros(buckets, np.int64)
        self._clear(0)

    def _clear(self, words: int = NODES) -> None:
        if not words or len(self.words) > words:
            self.words = _Numbers()
            self.first, self.later, self.size = (np.zeros(1024, np.uint32) for _ in range(3))  # CRC of a word, of a blank and it; bytes of these
        self.key, self.node = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted (parent, word), and which node that is
        self.n = 1
        self.crc, self.value = np.zeros(1024, np.uint32), np.zeros(1024, np.int64)

    def fold(self) -> np.ndarray:
        """Add the nodes' counts to the buckets' totals, and begin anew."""
        if self.gains is None:
            np.add.at(self.totals, self.crc[: self.n] % self.buckets, self.value[: self.n])
        self._clear()
        return self.totals

    def _numbers(self, flat: list[bytes]) -> np.ndarray:
        """The words by their numbers; new words get one."""
        at = len(self.words)
        out = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        if len(self.words) > at:
            new = [*itertools.islice(reversed(self.words), len(self.words) - at)][::-1]
            while len(self.words) > len(self.first):
                self.first, self.later, self.size = (np.r_[x, np.zeros_like(x)] for x in (self.first, self.later, self.size))
            own = slice(at, len(self.words))
            self.first[own], self.later[own], self.size[own] = [*map(zlib.crc32, new)], [zlib.crc32(b" " + w) for w in new], [len(w) + 1 for w in new]
        return out

    def _nodes(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The children by these words; those that are missing are made, each with its parent's CRC carried on by its word."""
        key, at = np.unique(parent << 32 | word, return_inverse=True)
        place = np.searchsorted(self.key, key)
        known = np.zeros(len(key), bool)
        if len(self.key):
            known = self.key[np.minimum(place, len(self.key) - 1)] == key
        node = np.zeros(len(key), np.int64)
        node[known] = self.node[place[known]]
        new = np.flatnonzero(~known)
        while self.n + len(new) > len(self.crc):
            self.crc, self.value = np.r_[self.crc, np.zeros_like(self.crc)], np.r_[self.value, np.zeros_like(self.value)]
        own = np.arange(self.n, self.n + len(new))
        above, below = key[new] >> 32, key[new] & 0xFFFFFFFF
        crc, size = np.where(above > 0, self.later[below], self.first[below]), self.size[below]
        for n in np.unique(size[above > 0]).tolist():
            k = np.flatnonzero((size == n) & (above > 0))
            c, by = self.crc[above[k]], _shift(n)
            crc[k] ^= by[0][c & 255] ^ by[1][c >> 8 & 255] ^ by[2][c >> 16 & 255] ^ by[3][c >> 24]
        self.crc[own] = crc
        if self.gains is not None:
            self.value[own] = self.gains[crc % self.buckets]
        self.key, self.node = np.insert(self.key, place[new], key[new]), np.insert(self.node, place[new], own)
        node[new] = own
        self.n += len(new)
        return node[at]

    def walk(self, texts: list[list[bytes]], skip: list[int]) -> np.ndarray:
        """Add the runs of each list of words that end at place `skip` or later; or, with gains, return the sum of theirs."""
        if self.n > NODES:
            self.fold()
        size = np.array([len(x) for x in texts], np.int64)
        flat = [w for x in texts for w in x]
        word = self._numbers(flat)
        begin = np.cumsum(size) - size
        place = np.arange(len(flat)) - np.repeat(begin, size)
        own = place >= np.repeat(np.array(skip, np.int64), size)
        sums, node = np.zeros(len(flat) + 1, np.int64), np.zeros(len(flat), np.int64)
        for k in range(self.run):  # node: that of the run of k words which ends before; root, for none
            at = np.flatnonzero(place >= k)
            above = node[at - 1] if k else node[at]
            node = np.zeros(len(flat), np.int64)
            node[at] = self._nodes(above, word[at])
            if self.gains is None:
                self.value[: self.n] += np.bincount(node[at][own[at]], minlength=self.n)
            else:
                sums[1:][at] += np.where(own[at], self.value[node[at]], 0)
        sums = np.cumsum(sums)
        return sums[begin + size] - sums[begin]


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text, cut between words into pieces of about PIECE bytes."""
    lo = 0
    while len(text) - lo > PIECE:
        m = _GAP.search(text, lo + PIECE)
        hi = m.start() if m else len(text)
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def _walked(trie: Trie, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(words, sums of gains) of each text; texts are walked together up to PIECE bytes, and longer ones by pieces."""
    words, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, list[bytes], int]] = []

    def flush() -> None:
        for k, s in zip([h[0] for h in held], trie.walk([h[1] for h in held], [h[2] for h in held]).tolist(), strict=True):
            sums[k] += s
        held.clear()

    size = 0
    for k, text in enumerate(texts):
        last: list[bytes] = []
        for piece in _pieces((text or b"").lower()):
            found = _WORD.findall(piece)
            words[k] += len(found)
            held.append((k, last + found, len(last)))
            last = (last + found)[-(trie.run - 1) :] if trie.run > 1 else []
            if (size := size + len(piece)) >= PIECE:
                flush()
                size = 0
    if held:
        flush()
    return words, sums


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n): how many features of all texts each bucket has, of those that have any; at most `buckets` rows."""
    importable(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets, run)
        for batch in batches:
            _walked(trie, batch.column(0).to_pylist())
            tidy()
        n = trie.fold()
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["bucket", "n"])

    each = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(tidied(count), "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> list[int]:
    out = [0] * buckets
    for r in counts.collect():  # at most a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """For each bucket floor(1000 ln(p/q)): p, its share in the target's features, and q, in the documents', each with one
    more feature for each bucket."""
    s, t = _dense(bucket_counts(docs, text_col, buckets, run), buckets), _dense(bucket_counts(target, text_col, buckets, run), buckets)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(float(y + 1) * all_s / (float(x + 1) * all_t))) for x, y in zip(s, t, strict=True)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, seed: int = SEED) -> DataFrame:
    """docs with a column drawn_by, or of a like name if they have that: (n_words, n_features, weight, score) of each row."""
    importable(docs.sparkSession)

    @F.arrow_udf("struct<n_words: bigint, n_features: bigint, weight: bigint>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Trie(len(gain), run, gain)
        for texts in batches:
            words, sums = _walked(trie, texts.to_pylist())
            features = sum(np.maximum(words - k, 0) for k in range(run))
            weight = np.where(features > 0, np.floor_divide(sums, np.maximum(features, 1)), 0)
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (words, features, weight)], ["n_words", "n_features", "weight"])
            tidy()

    own, h = unused(docs, "drawn_by"), F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    at = docs.withColumn(own, weigh(F.col(text_col).cast("binary")))
    return at.withColumn(own, F.struct(f"{own}.n_words", f"{own}.n_features", f"{own}.weight", (F.col(f"{own}.weight") + luck).cast("long").alias("score")))


def _ranked(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, run: int, share: int, least_words: int, seed: int) -> DataFrame:
    """resample's rows, with a column id."""
    at = scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), gain, "id", "text", run, seed)
    at = materialize(at.select("id", "drawn_by.*"), "scores")
    able = at.where(F.col("n_words") >= least_words).withColumns({"tie": F.monotonically_increasing_id(), "one": F.lit(1).cast("long")})
    most = share * able.count() // 100
    ranked = prefix_sums(able, [F.desc("score"), F.asc_nulls_last("id"), F.asc("tie")], "one").withColumn("rank", F.col("before") + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")).cast("long"))
    rest = at.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    names = ["id", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(rest.select(*names))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = BUCKETS, run: int = RUN, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """(id_col, n_features, weight, score, rank) for each row of docs; rank 1, 2, 3... for those that are drawn, else null.

    Features are the runs of 1 to `run` words of a text (A-Z folded; runs of digits, letters and characters beyond ASCII), repeats
    counted, each in the bucket of its CRC-32. weight is the floored mean of the gains of a text's features (see gains), 0
    without features; score adds to it a Gumbel variate that follows from the seed and the id. Of the rows with at least
    `least_words` words, `share` in a hundred (floored) are drawn: those with the greatest scores, of equal ones those with the least ids,
    null ids last; rows that repeat an id and a score take ranks in any order. Null texts have no words; an id that is
    null counts as empty text. target has the same text column; if it is empty, gains only say how rare a bucket is.
    Other columns are ignored. Scores are ranked by ranges of the sorted rows, which split a score or id of any number of rows.
    """
    gain = gains(docs, target, text_col, buckets, run)
    return _ranked(docs, gain, id_col, text_col, run, share, least_words, seed).withColumnRenamed("id", id_col)


def draw(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = BUCKETS, run: int = RUN, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """The rows of docs that resample draws, with all their columns and without a shuffle of texts: they are scored again, and
    stand against the last that was drawn. Rows that repeat its score and id are drawn too."""
    gain = gains(docs, target, text_col, buckets, run)
    ranked = _ranked(docs, gain, id_col, text_col, run, share, least_words, seed)
    last = ranked.agg(F.max_by(F.struct("score", "id"), "rank").alias("last")).first()["last"]
    own = unused(docs, "drawn_by")
    if last is None:
        return docs.limit(0)
    tied = F.lit(True) if last["id"] is None else F.coalesce(F.col(id_col) <= F.lit(last["id"]), F.lit(False))  # null ids come last
    score = F.col(f"{own}.score")
    drawn = (F.col(f"{own}.n_words") >= least_words) & ((score > last["score"]) | (score == last["score"]) & tied)
    return scored(docs, gain, id_col, text_col, run, seed).where(drawn).drop(own)
