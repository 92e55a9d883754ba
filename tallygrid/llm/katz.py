"""Katz backoff language model of any order.

Counts are discounted by Good-Turing; what that frees goes to words not seen after a context, in proportion to their
probabilities after the context without its first word, and so on down to single words, with weights that make each
context's distribution sum to exactly one, unknown words (one class) included.

Learning goes by orders. Each block of documents (see blocks.py) asks once for its distinct words, then for its distinct
pairs, and so on: an n-gram is the number of the n-gram before its last word, and that word's number. A bucket adds up
what blocks counted in training texts, writes its part of the model, and answers from it. A context that very many
n-grams share is dealt over several buckets, and its sums are additive. The model is a folder of Parquet, partitioned by
order, which scores any other texts: their blocks ask alike, and the tables answer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .shared import importable, materialize, workspace

BLOCK_BYTES = 5_000_000
#: Counts up to this one are discounted.
K = 5
#: Words of an n-gram.
ORDER = 2
#: The hash of the token that ends a text (no word has white space in it), and the number of the context that begins one.
END = xxhash.xxh3_64_intdigest(b" ")
BEGIN = (1 << 62) - 1


def held_out(doc_id, folds: int = 10) -> bool:
    """Whether a document is kept from training: crc32 of its id as text is 0 modulo folds. Null is."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


def discounts(times: list[int]) -> np.ndarray:
    """The factor for counts 0 to K, and 1 beyond, from how many things were seen 1, 2, ..., K + 1 times.

    Where Good-Turing's factor, as Katz has it, isn't between 0 and 1, absolute discounting takes its place.
    """
    n = [0, *times]
    share = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    d = (n[1] / (n[1] + 2 * n[2])) if n[1] and n[1] + 2 * n[2] else 0.5
    d = min(max(d, 0.1), 0.9)
    out = [1.0]
    for r in range(1, K + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if n[r] and share < 1 else 0.0
        out.append(x if 0 < x < 1 else (r - d) / r)
    return np.array([*out, 1.0])


def unigram(c: np.ndarray, total: int, d: np.ndarray, times: list[int]) -> tuple[np.ndarray, float]:
    """(probabilities of words with counts c, probability of the unknown word)."""
    if not total:
        return np.zeros(len(c)), 1.0
    free = sum(times[r - 1] * r * (1 - d[r]) for r in range(1, K + 1)) / total
    if free <= 0:  # no count is low: one more event is set aside for the unknown word
        return c / (total + 1), 1 / (total + 1)
    return d[np.minimum(c, K + 1)] * c / total, free


def freed(total: np.ndarray, low: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share that is left for words not seen after a context, whether it had to be made), for arrays of contexts.

    total: how often each occurs; low: (K, n), how many words follow it 1 to K times. Where no count is low, one more
    event is set aside.
    """
    known = np.maximum(total, 1)
    free = (low * (np.arange(1, K + 1) * (1 - d[1 : K + 1]))[:, None]).sum(0) / known
    return np.where(free <= 0, 1 / (known + 1), free), free <= 0


def _by_count(c: np.ndarray, all_words: Words, d: np.ndarray) -> np.ndarray:
    return unigram(c, all_words.total, d, all_words.times)[0]


def conditional(c: np.ndarray, total: np.ndarray, low: np.ndarray, seen: np.ndarray, p: np.ndarray, d: np.ndarray) -> np.ndarray:
    """P(word | context), for arrays of n-grams.

    c: the n-gram's count; total: the context's; low: as for freed; seen: the sum of the probabilities, after the shorter
    context, of all words that follow it; p: the word's own there, to which an unseen n-gram falls back.
    """
    known = np.maximum(total, 1)
    free, spare = freed(total, low, d)
    direct = np.where(spare, c / (known + 1), d[np.minimum(c, K + 1)] * c / known)
    return np.where(total == 0, p, np.where(c > 0, direct, free / (1 - seen) * p))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = blocks.block_ids()
    for ids, texts in blocks.grouped(batches, BLOCK_BYTES):
        place: dict[bytes, int] = {b" ": 0}
        seq, sizes = [], []
        for x in texts:
            words = x.lower().split()  # of bytes: A-Z only, and at ASCII white space only
            for w in words:
                if w not in place:
                    place[w] = len(place)
            seq += map(place.__getitem__, words)
            seq.append(0)
            sizes.append(len(words) + 1)
        keys = ids.to_pylist()
        fields = {
            "words": np.fromiter((xxhash.xxh3_64_intdigest(w) for w in place), "<u8", len(place)).tobytes(),
            "seq": blocks.squeeze(np.array(seq, "<u4")), "sizes": np.array(sizes, "<u4").tobytes(), "held": bytes(map(held_out, keys)),
        }
        yield pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), pa.array([keys], pa.list_(ids.type)), *(pa.array([x], pa.binary()) for x in fields.values())], ["block", "ids", *fields])


class Level(NamedTuple):
    """What a driver knows of an order: how many n-grams are before each bucket's, and the discounts."""

    offsets: list[int]
    d: np.ndarray


class Words(NamedTuple):
    """And of the words: all tokens, distinct ones, how many occur 1 to K + 1 times."""

    total: int
    distinct: int
    times: list[int]


class _Block:
    """A block's tokens, and what is known of them up to some order: p, the probability of each after the context so far;
    context, the number of the n-gram before it (-1: not seen), and how often that occurs."""

    def __init__(self, words: bytes, seq: bytes, sizes: bytes, held: bytes):
        self.words = np.frombuffer(words, "<u8")
        (self.seq,) = blocks.unsqueeze(seq, "<u4")
        self.seq = self.seq.astype(np.int64)
        self.sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
        self.held = np.frombuffer(held, np.uint8) > 0
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~self.held, self.sizes)
        self.order = np.argsort(self.words)

    def start(self, got: list[dict], level: Level, all_words: Words) -> None:
        """Take the counts and numbers of the words from the buckets' answers."""
        counts, numbers = [], []
        for x in sorted(got, key=lambda x: x["bucket"]):
            c, k = blocks.unsqueeze(x["payload"], "<u4", "<u4")
            counts.append(c)
            numbers.append(k.astype(np.int64) + level.offsets[x["bucket"]] if len(k) else np.full(len(c), -1))
        self.count, self.number = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        self.count[self.order], self.number[self.order] = np.concatenate(counts), np.concatenate(numbers)
        p, unknown = unigram(self.count, all_words.total, level.d, all_words.times)
        self.p = np.where(self.count > 0, p, unknown)[self.seq]
        self.follow(np.where(self.count > 0, self.number, -1)[self.seq], self.count[self.seq])
        # What begins a text occurs once for each end.
        self.context[self.begin], self.times[self.begin] = BEGIN if self.count[0] else -1, self.count[0]

    def follow(self, number: np.ndarray, count: np.ndarray) -> None:
        """The n-grams that end at each token are the contexts of the next."""
        self.context, self.times = np.full(len(self.seq), -1), np.zeros(len(self.seq), np.int64)
        self.context[1:], self.times[1:] = number[:-1], count[:-1]
        self.context[self.begin], self.times[self.begin] = -1, 0

    def ask(self, buckets: int, total: int, others: bool) -> None:
        """The distinct n-grams of known contexts and words, by bucket, context and word; `where` leads from tokens to
        them, or is -1; and the contexts, by bucket and number. Their sums are needed of those after which a word may be
        that wasn't seen there: in texts held out, or in all, if the model is of others."""
        own, self.which = np.unique(self.context, return_inverse=True)
        self.own, self.own_times = own, np.zeros(len(own), np.int64)
        self.own_times[self.which] = self.times
        known = np.flatnonzero((self.count[self.seq] > 0) & (self.context >= 0))
        code, first, back = np.unique(self.which[known] * (len(self.words) + 1) + self.seq[known], return_index=True, return_inverse=True)
        n = np.bincount(back, self.train[known], len(code)).astype("<u4")
        one, two = code // (len(self.words) + 1), code % (len(self.words) + 1)
        context, word = own[one], self.number[two]
        # A context with more than a bucket's share of all tokens is dealt over as many more buckets.
        ways = 1 + self.own_times * buckets // max(total, 1)
        bucket = _bucket(context, word % ways[one], buckets)
        order = np.lexsort((word, context, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.where = np.full(len(self.seq), -1)
        self.where[known] = rank[back]
        self.word, self.n, self.lower, self.own_count = word[order], n[order], self.p[known[first]][order], self.count[two][order]
        # The sums of a context are asked of all its buckets, even where none of its n-grams here is known there.
        asked = np.flatnonzero(own >= 0)
        each = np.repeat(asked, ways[asked])
        salt = np.arange(len(each)) - np.repeat(np.cumsum(ways[asked]) - ways[asked], ways[asked])
        head = np.unique(_bucket(own[each], salt, buckets) * len(own) + each)
        self.need = np.full(len(own), others)
        self.need[self.which[~self.train]] = True
        self.head_bucket, self.head = head // max(len(own), 1), head % max(len(own), 1)  # `own` is sorted, so heads are by number
        mine = bucket[order] * len(own) + one[order]
        self.head_at = np.r_[np.searchsorted(mine, self.head_bucket * len(own) + self.head), len(order)]

    def take(self, told: list[dict] | None, level: Level, more: bool) -> None:
        """The answers: a token's probability is now that after one more word. more: there is an order above."""
        low, seen = np.zeros((K, len(self.own))), np.zeros(len(self.own))
        c, number = np.zeros(len(self.word) + 1, np.int64), np.full(len(self.word) + 1, -1)
        if len(self.head):
            parts = [(x["bucket"], *blocks.unsqueeze(x["payload"], "<u4", "<u4", "<u1", *["<u4"] * K, "<f8")) for x in sorted(told or [], key=lambda x: x["bucket"])]
            c[:-1] = np.concatenate([x[1] for x in parts])
            if more:
                number[:-1] = np.concatenate([x[2].astype(np.int64) + level.offsets[x[0]] for x in parts])
                number[c == 0] = -1
            whole = self.head[self.need[self.head]]
            np.add.at(seen, whole, np.concatenate([x[-1] for x in parts]))
            for r in range(K):
                np.add.at(low[r], whole, np.concatenate([x[4 + r] for x in parts]))
            # Of the others it is enough to know whether they have low counts: all that comes after them was seen there.
            some = self.head[np.concatenate([x[3] for x in parts]) > 0]
            low[0, some[~self.need[some]]] = 1
        times = np.where(self.context >= 0, self.times, 0)
        self.p = conditional(c[self.where], times, low[:, self.which], seen[self.which], self.p, level.d)
        if more:
            self.follow(number[self.where], c[self.where])


def _bucket(context: np.ndarray, salt: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = (context * 0x9E3779B1 + salt * 0x85EBCA6B + 0x27D4EB2F).astype(np.uint64)
        key = (key ^ (key >> np.uint64(15))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _word_messages(buckets: int):
    def messages(words: bytes, seq: bytes, sizes: bytes, held: bytes) -> Iterable[blocks.Message]:
        b = _Block(words, seq, sizes, held)
        n = np.bincount(b.seq[b.train], minlength=len(b.words))[b.order].astype("<u4")
        h = b.words[b.order]
        for k, part in blocks.by_bucket(h, buckets):
            yield k, blocks.squeeze(h[part], n[part])

    return messages


def _replayed(values: tuple, got: list[dict], told: list, levels: list[Level], all_words: Words, buckets: int, last: bool, others: bool = False) -> _Block:
    """A block with all that is known of it: the words' answers, and those of each order above one. last: no order
    follows; else the n-grams of the next are made."""
    b = _Block(*values)
    b.start(got, levels[0], all_words)
    for k, x in enumerate(told, 1):
        b.ask(buckets, all_words.total, others)
        b.take(x, levels[k], not last or k < len(told))
    if not last:
        b.ask(buckets, all_words.total, others)
    return b


def _gram_messages(buckets: int, levels: list[Level], all_words: Words, others: bool = False):
    def messages(words: bytes, seq: bytes, sizes: bytes, held: bytes, got: list[dict], *told) -> Iterable[blocks.Message]:
        b = _replayed((words, seq, sizes, held), got, [*told], levels, all_words, buckets, False, others)
        for k in np.unique(b.head_bucket).tolist():
            one, beyond = np.searchsorted(b.head_bucket, [k, k + 1])
            lo, hi = b.head_at[one], b.head_at[beyond]
            # After no context a word's count tells its probability; after others each distinct one is sent once.
            lower, at = (np.zeros(0), b.own_count[lo:hi]) if len(levels) == 1 else np.unique(b.lower[lo:hi], return_inverse=True)
            yield k, blocks.squeeze(b.own[b.head[one:beyond]].astype("<u8"), b.need[b.head[one:beyond]].astype("<u1"), np.diff(b.head_at[one : beyond + 1]).astype("<u4"), b.word[lo:hi].astype("<u4"), b.n[lo:hi], lower.astype("<f8"), at.astype("<u4"))

    return messages


class Asked(NamedTuple):
    """Contexts, whether their sums are needed, the number of n-grams of each; those' last words and counts in training,
    and which of the distinct probabilities `lower` each has after the shorter context. Without such, `at` has the words'
    counts."""

    context: np.ndarray
    need: np.ndarray
    size: np.ndarray
    word: np.ndarray
    n: np.ndarray
    lower: np.ndarray
    at: np.ndarray

    @classmethod
    def open(cls, payload: bytes) -> Asked:
        context, need, size, word, n, lower, at = blocks.unsqueeze(payload, "<u8", "<u1", "<u4", "<u4", "<u4", "<f8", "<u4")
        return cls(context.astype(np.int64), need > 0, size.astype(np.int64), word.astype(np.int64), n, lower, at.astype(np.int64))


class Grams(NamedTuple):
    """A bucket's part of the model: for words, word has their hashes, and what is of contexts is empty; above, contexts in
    order, the number of n-grams of each, their last words and counts, the sum of those, how many of them occur 1 to K
    times (a row of K for each context), and the sum of their words' probabilities after the shorter context."""

    context: np.ndarray
    size: np.ndarray
    word: np.ndarray
    count: np.ndarray
    times: np.ndarray
    low: np.ndarray
    seen: np.ndarray

    @classmethod
    def read(cls, rows: pa.Table) -> Grams:
        """Of a table of one row, or of none."""
        columns = [pa.concat_arrays([x for c in rows.column(name).chunks if len(x := c.flatten())] or [pa.array([], t)]) for name, t in _TYPES.items()]
        return cls(*(c.to_numpy(zero_copy_only=False) for c in columns))


_TYPES = {"context": pa.int64(), "size": pa.int32(), "word": pa.int64(), "count": pa.int64(), "times": pa.int64(), "low": pa.int32(), "seen": pa.float64()}


def learn_words(payloads: list[bytes]) -> Grams:
    sent = [blocks.unsqueeze(p, "<u8", "<u4") for p in payloads]
    h, where = np.unique(np.concatenate([h for h, _ in sent]), return_inverse=True)
    total = np.bincount(where, np.concatenate([n for _, n in sent]), len(h)).astype(np.int64)
    none = np.zeros(0, np.int64)
    return Grams(none, none, h[total > 0].view(np.int64), total[total > 0], none, none, np.zeros(0))


def look_up_words(model: Grams, payloads: list[bytes], more: bool) -> list[bytes]:
    """To each block the counts of its words in training, and their numbers in the bucket (of those that occur there).
    more: there is an order above, for which numbers are needed."""
    h, out = model.word.view(np.uint64), []
    for p in payloads:
        asked, _ = blocks.unsqueeze(p, "<u8", "<u4")
        at = np.minimum(np.searchsorted(h, asked), max(len(h) - 1, 0))
        ok = h[at] == asked if len(h) else np.zeros(len(asked), bool)
        out.append(blocks.squeeze(np.where(ok, model.count[at] if len(h) else 0, 0).astype("<u4"), np.where(ok, at, 0)[: None if more else 0].astype("<u4")))
    return out


def learn_grams(payloads: list[bytes], one: Callable[[np.ndarray], np.ndarray]) -> Grams:
    """one: the probabilities of words by their counts."""
    sent = [*map(Asked.open, payloads)]
    context, where = np.unique(np.concatenate([x.context for x in sent]), return_inverse=True)
    code = np.repeat(where, np.concatenate([x.size for x in sent])).astype(np.uint64) << np.uint64(32) | np.concatenate([x.word for x in sent]).astype(np.uint64)
    code, first, back = np.unique(code, return_index=True, return_inverse=True)
    c = np.bincount(back, np.concatenate([x.n for x in sent]), len(code)).astype(np.int64)
    lower = np.concatenate([x.lower[x.at] if len(x.lower) else one(x.at) for x in sent])[first]
    keep = c > 0
    code, c, lower = code[keep], c[keep], lower[keep]
    at = (code >> np.uint64(32)).astype(np.int64)
    low = np.stack([np.bincount(at[c == r], minlength=len(context)) for r in range(1, K + 1)], 1)
    size, seen = np.bincount(at, minlength=len(context)), np.bincount(at, lower, len(context))
    some = size > 0
    times = np.bincount(at, c, len(context)).astype(np.int64)
    return Grams(context[some], size[some], (code & np.uint64(0xFFFFFFFF)).astype(np.int64), c, times[some], low[some].reshape(-1), seen[some])


def look_up_grams(model: Grams, payloads: list[bytes], more: bool) -> list[bytes]:
    """To each block the counts and numbers of its n-grams, whether its contexts have words that follow 1 to K times, and,
    where that is needed, how many of each, and the sum of the probabilities of all that follow; these are sums over this
    bucket."""
    low, out = model.low.reshape(-1, K), []
    some, none = low.any(1), not len(model.context)
    code = np.repeat(np.arange(len(model.context), dtype=np.uint64), model.size) << np.uint64(32) | model.word.astype(np.uint64)
    for p in payloads:
        x = Asked.open(p)
        if none:
            out.append(blocks.squeeze(*(np.zeros(len(x.word) * k, "<u4") for k in (1, more)), np.zeros(len(x.context), "<u1"), *[np.zeros(int(x.need.sum()), "<u4")] * K, np.zeros(int(x.need.sum()))))
            continue
        at = np.minimum(np.searchsorted(model.context, x.context), len(model.context) - 1)
        ok = model.context[at] == x.context
        asked = np.repeat(at, x.size).astype(np.uint64) << np.uint64(32) | x.word.astype(np.uint64)
        k = np.minimum(np.searchsorted(code, asked), len(code) - 1)
        hit = np.repeat(ok, x.size) & (code[k] == asked)
        sums = [np.where(ok, low[at, r], 0)[x.need].astype("<u4") for r in range(K)]
        out.append(blocks.squeeze(
            np.where(hit, model.count[k], 0).astype("<u4"), np.where(hit, k, 0)[: None if more else 0].astype("<u4"), (ok & some[at]).astype("<u1"),
            *sums, np.where(ok, model.seen[at], 0.0)[x.need].astype("<f8"),
        ))
    return out


_MODEL = "kind string, block long, bucket int, payload binary, n long, context array<long>, size array<int>, word array<long>, count array<long>, times array<long>, low array<int>, seen array<double>"


def _learn(learn: Callable[[list[bytes]], Grams], look: Callable[[Grams, list[bytes], bool], list[bytes]], more: bool):
    """A bucket's part of the model (kind "model"), what its counts add up to ("summary") and its answers ("answer")."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        payloads = rows.column("payload").to_pylist()
        model = learn(payloads)
        answers = look(model, payloads, more)
        bucket, n = rows.column("bucket")[0].as_py(), len(answers)
        times = np.bincount(np.minimum(model.count, K + 2), minlength=K + 3)[1 : K + 2]
        summary = struct.pack(f"<{K + 2}q", int(model.count.sum()), *times.tolist())
        columns = {
            "kind": pa.array(["answer"] * n + ["summary", "model"], pa.string()), "block": pa.array([*rows.column("block").to_pylist(), None, None], pa.int64()),
            "bucket": pa.array([bucket] * (n + 2), pa.int32()), "payload": pa.array([*answers, summary, None], pa.binary()), "n": pa.array([None] * n + [len(model.count)] * 2, pa.int64()),
        }
        for name, t in _TYPES.items():
            values = pa.array(getattr(model, name), t)
            offsets = pa.array([0] * (n + 2) + [len(values)], pa.int32())
            columns[name] = pa.ListArray.from_arrays(offsets, values)
        blocks.tidy()
        return pa.table(columns)

    return run


def _read(look: Callable[[Grams, list[bytes], bool], list[bytes]], more: bool):
    """A bucket's answers from its part of the model."""

    def run(key: tuple, asked: pa.Table, model: pa.Table) -> pa.Table:
        answers = look(Grams.read(model), asked.column("payload").to_pylist(), more)
        blocks.tidy()
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "payload": pa.array(answers, pa.binary())})

    return run


class Model:
    """A model in a folder: Parquet for each order, in it kind=model (a row a bucket, see Grams), kind=summary."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, order: int):
        self.spark, self.path, self.buckets, self.order = spark, path, buckets, order

    def part(self, k: int, kind: str) -> DataFrame:
        return self.spark.read.schema(_MODEL).parquet(f"{self.path}/order={k}").where(F.col("kind") == kind)

    def level(self, k: int) -> tuple[Level, tuple[int, int, list[int]]]:
        """And all tokens, n-grams and counts of counts of an order: sums over a row a bucket."""
        rows = {r["bucket"]: (r["n"], struct.unpack(f"<{K + 2}q", r["payload"])) for r in self.part(k, "summary").select("bucket", "n", "payload").collect()}
        offsets, n = [], 0
        for bucket in range(self.buckets):
            offsets.append(n)
            n += rows[bucket][0] if bucket in rows else 0
        total, times = sum(x[0] for _, x in rows.values()), [sum(x[1 + r] for _, x in rows.values()) for r in range(K + 1)]
        return Level(offsets, discounts(times)), (total, n, times)

    def levels(self) -> tuple[list[Level], Words]:
        got = [self.level(k) for k in range(1, self.order + 1)]
        return [x for x, _ in got], Words(*got[0][1])

    def grams(self, k: int) -> DataFrame:
        """(context, word, number, count) of the n-grams of an order above 1: context is the number of the n-gram of the
        order below that its first words are (BEGIN: what begins a text), word that of its last word."""
        offsets = self.level(k)[0].offsets
        spread = self.part(k, "model").select("bucket", F.flatten(F.transform(F.arrays_zip("context", "size"), lambda x: F.array_repeat(x.context, x["size"]))).alias("context"), "word", "count")
        start = F.element_at(F.lit(offsets), F.col("bucket") + 1)
        rows = spread.select(start.alias("start"), F.posexplode(F.arrays_zip("context", "word", "count")).alias("at", "x"))
        return rows.select("x.context", "x.word", (F.col("start") + F.col("at")).alias("number"), "x.count")

    def words(self) -> DataFrame:
        """(hash, number, count)."""
        start = F.element_at(F.lit(self.level(1)[0].offsets), F.col("bucket") + 1)
        rows = self.part(1, "model").select(start.alias("start"), F.posexplode(F.arrays_zip("word", "count")).alias("at", "x"))
        return rows.select(F.col("x.word").alias("hash"), (F.col("start") + F.col("at")).alias("number"), "x.count")

    def make_weights(self, k: int) -> None:
        """Store (context, times, weight) of the contexts of an order: weight is that of words not seen after it, which
        makes its distribution sum to one. Sums of a context that is dealt over buckets are added up."""
        d, lows = self.level(k)[0].d, [f"low{r}" for r in range(1, K + 1)]
        at = self.part(k, "model").select(F.posexplode(F.arrays_zip("context", "times", "seen")).alias("at", "x"), "low")
        at = at.select("x.*", *(F.get("low", F.col("at") * K + r).cast("long").alias(c) for r, c in enumerate(lows)))
        at = at.groupBy("context").agg(*(F.sum(c).alias(c) for c in ("times", "seen", *lows)))
        lost = reduce(lambda x, r: x + F.col(lows[r - 1]) * float(r * (1 - d[r])), range(1, K + 1), F.lit(0.0))
        left = F.when(lost > 0, lost / F.col("times")).otherwise(1 / (F.col("times") + 1))
        at = at.select("context", "times", (left / (1 - F.col("seen"))).alias("weight"))
        at.write.option("compression", "zstd").parquet(f"{self.path}/weights/order={k}")

    def weights(self, k: int) -> DataFrame:
        return self.spark.read.schema("context long, times long, weight double").parquet(f"{self.path}/weights/order={k}")

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """As score() below, for any texts, from the tables."""
        table, (levels, all_words) = _blocks(docs, id_col, text_col), self.levels()
        n, told = self.buckets, []
        for k in range(1, self.order + 1):
            both = _with_answers(table, told)
            messages = _word_messages(n) if k == 1 else _gram_messages(n, levels[: k - 1], all_words, True)
            asked = blocks.ask(both, [*_FIELDS, *_columns(told)], messages)
            look = look_up_words if k == 1 else look_up_grams
            answered = asked.groupBy("bucket").cogroup(self.part(k, "model").groupBy("bucket")).applyInArrow(_read(look, k < self.order), "block long, bucket int, payload binary")
            told.append(materialize(blocks.gather(answered), "katz-told"))
        return _scores(table, told, levels, all_words, n, id_col, True)


_FIELDS = ["words", "seq", "sizes", "held"]


def _columns(told: list) -> list[str]:
    return [f"told{k}" for k in range(1, len(told) + 1)]


def _with_answers(table: DataFrame, told: list[DataFrame]) -> DataFrame:
    for k, x in enumerate(told, 1):
        table = table.join(x.withColumnRenamed("got", f"told{k}"), "block", "left")
    return table


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    return blocks.store(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_build, f"block long, ids array<{kind}>, words binary, seq binary, sizes binary, held binary"), "katz")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> Model:
    """A model of the training rows (see score), in a new folder of the shared one."""
    importable(docs.sparkSession)
    return _fit(_blocks(docs, id_col, text_col), order)[0]


def _fit(table: DataFrame, order: int) -> tuple[Model, list[DataFrame], list[Level], Words]:
    """And what its buckets answer to the table's own blocks."""
    spark, n = table.sparkSession, blocks.buckets(table)
    model, told, levels, all_words = Model(spark, workspace(spark, "katz-model"), n, order), [], [], None
    for k in range(1, order + 1):
        messages = _word_messages(n) if k == 1 else _gram_messages(n, [*levels], all_words)
        asked = blocks.ask(_with_answers(table, told), [*_FIELDS, *_columns(told)], messages)
        if k == 1:
            run = _learn(learn_words, look_up_words, k < order)
        else:
            one = partial(_by_count, all_words=all_words, d=levels[0].d)
            run = _learn(partial(learn_grams, one=one), look_up_grams, k < order)
        asked.groupBy("bucket").applyInArrow(run, _MODEL).write.option("compression", "zstd").partitionBy("kind").parquet(f"{model.path}/order={k}")
        level, sums = model.level(k)
        levels.append(level)
        all_words = all_words or Words(*sums)
        if k > 1:
            model.make_weights(k)
        answers = blocks.gather(model.part(k, "answer").select("block", "bucket", "payload"))
        told.append(materialize(answers, "katz-told") if k < order else answers)
    return model, told, levels, all_words


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Tokens are the words between ASCII white space, with A-Z folded, and one end for each text, which null and empty
    texts have alone. The model, of n-grams of up to `order` words, learns from rows whose crc32 of the id as text isn't 0
    modulo 10; a null id is held out. score is the model's log10 probability of all tokens, base_score that of single
    words with 0.1 added to each count and one more class for unknown words. Without training rows every token is unknown
    and both scores are 0. Rows may repeat and count as often; other columns are ignored; an empty table gives no rows.
    """
    importable(docs.sparkSession)
    table = _blocks(docs, id_col, text_col)
    _, told, levels, all_words = _fit(table, order)
    return _scores(table, told, levels, all_words, blocks.buckets(docs), id_col)


def _scores(table: DataFrame, told: list[DataFrame], levels: list[Level], all_words: Words, buckets: int, id_col: str, others: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids, *values = (c[k].as_py() for c in batch.columns)
                b = _replayed(values[:4], values[4], values[5:], levels, all_words, buckets, True, others)
                base = np.log10((b.count + 0.1) / (all_words.total + 0.1 * (all_words.distinct + 1)))[b.seq]
                sum_up = lambda x, b=b: np.add.reduceat(x, b.begin)
                columns = [
                    pa.array(ids, batch.column(0).type.value_type), pa.array(b.held), pa.array(b.sizes), pa.array(sum_up((b.count[b.seq] > 0).astype(np.int64))),
                    pa.array(np.full(len(ids), all_words.total, np.int64)), pa.array(sum_up(base)), pa.array(sum_up(np.log10(b.p))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(table.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    both = _with_answers(table, told)
    return both.select("ids", *_FIELDS, *_columns(told)).mapInArrow(blocks.tidied(run), schema)
