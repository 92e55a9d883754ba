"""Byte-level BPE encoding and decoding with a lexicon in a minimal acyclic transducer.

Words (pieces that merges never cross) are counted over all texts. The most frequent are compiled, with their token ids,
into a minimal acyclic automaton whose transitions add up to the number of the word and so to its ids; common suffixes
share states. The compiled file is handed to the executors, which map it into memory. Words that it doesn't hold are
merged exactly.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken
from .blocks import tidied
from .shared import importable, materialize, put, workspace

#: Words in the lexicon.
LEXICON_WORDS = 65_536
#: The most bytes of a word in the lexicon: longer ones are merged whenever they occur, with the same ids.
LEXICON_BYTES = 256
#: Bytes of words, with their ids, that a worker remembers; beyond them it forgets all and begins anew.
REMEMBERED = 80_000_000
#: What Python needs for a word and its ids, besides their own bytes.
OVERHEAD = 180
#: From this many bytes a word is merged with a heap.
LONG = 64
#: Distinct strings that a task counts before it hands them on.
COUNTED = 200_000


class Merges:
    """The merges of a vocabulary file of the tokenizers library, on token ids."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        # The library writes bytes as characters: those that print as themselves, the others from 256 on, in order.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(own)]
        self.byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
        assert set(self.byte_of) == set(pre_tokenizers.ByteLevel.alphabet())
        self.first = [0] * 256
        for c, b in self.byte_of.items():
            self.first[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.table = None
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special = next(iter(special), "")
        self.special_id = special.get(self.special, -1)
        size = 1 + max([*vocab.values(), *special.values()])
        self.bytes_of = [b""] * size
        for x, k in vocab.items():
            self.bytes_of[k] = x.encode() if x in special else bytes(map(self.byte_of.__getitem__, x))
        for x, k in special.items():
            self.bytes_of[k] = x.encode()

    def encode(self, word: bytes) -> list[int]:
        """The ids of one word: again and again the pair that was learnt first is merged, from the left."""
        ids = [self.first[b] for b in word]
        if len(ids) > LONG:
            return self._encode_long(ids)
        rank, made, none = self.rank.get, self.made, len(self.made)
        while len(ids) > 1:
            ranks = [rank(p, none) for p in zip(ids, ids[1:])]  # noqa: B905
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [made[best]]
        return ids

    def encode_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of many words, as little-endian 32-bit integers: each round merges one pair in every word not yet done."""
        out = [b""] * len(words)
        short = []
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = struct.pack(f"<{len(i := self.encode(w))}I", *i)
            elif w:
                short.append(k)
        if not short:
            return out
        none, size = len(self.made), len(self.bytes_of)
        if self.table is None:
            keys = np.array([a * size + b for a, b in self.rank], np.int64)
            order = np.argsort(keys)
            self.table = keys[order], np.array([*self.rank.values()], np.int64)[order], np.array(self.made, np.int64), np.array(self.first, np.int64)
        keys, ranks, made, first = self.table

        def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a * size + b
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[k] == key, ranks[k], none)

        ids = first[np.frombuffer(b"".join([words[k] for k in short]), np.uint8)]
        word = np.repeat(np.arange(len(short)), [len(words[k]) for k in short])
        same = word[:-1] == word[1:]
        rank = np.full(len(ids), none)
        rank[:-1][same] = look(ids[:-1][same], ids[1:][same])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, at), np.diff(np.r_[at, len(ids)]))
            over = best == none
            if over.any():
                done.append((word[over], ids[over]))
                ids, word, rank, best = (x[~over] for x in (ids, word, rank, best))
            hit = np.flatnonzero(rank == best)
            hit = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]] if len(hit) else hit
            ids[hit] = made[rank[hit]]
            left = np.ones(len(ids), bool)
            left[hit + 1] = False
            new = hit - np.arange(len(hit))  # a pair merged in a word before moves what follows by one
            ids, word, rank = ids[left], word[left], rank[left]
            for k in (new, new[new > 0] - 1):
                k, ends = k[k + 1 < len(ids)], k[k + 1 >= len(ids)]
                inner = word[k] == word[k + 1]
                rank[k] = none
                rank[ends] = none
                k = k[inner]
                rank[k] = look(ids[k], ids[k + 1])
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        flat, ends = ids[order].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(word, minlength=len(short)))).tolist()
        for k, a, b in zip(short, [0, *ends], ends):  # noqa: B905
            out[k] = flat[a:b]
        return out

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        n, rank = len(ids), self.rank.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank((a, b))) is not None]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = right[k]
            if j < 0 or ids[k] != a or ids[j] != b:
                continue
            ids[k], ids[j] = self.made[r], -1
            right[k] = right[j]
            if right[j] >= 0:
                left[right[j]] = k
            right[j] = -1
            for i in (left[k], k):
                if i >= 0 and right[i] >= 0 and (r := rank((ids[i], ids[right[i]]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[right[i]]))
        return [x for x in ids if x >= 0]


@functools.lru_cache(4)
def merges(path: str) -> Merges:
    return Merges(path)


class Lexicon:
    """Words and their ids in a minimal acyclic transducer.

    A transition is keyed by 256 * state + byte and carries the number of words that precede those behind it, so that the
    sum along a word's path, with one for each word that ends on the way, is its number in order; that finds its ids.
    """

    NAMES = ("keys", "to", "adds", "final", "at", "ids")
    TYPES = ("<i8", "<i4", "<i4", "<i1", "<i8", "<u4")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__ |= arrays

    @classmethod
    def compile(cls, words: Iterable[bytes], encode) -> Lexicon:
        """Words may come in any order and repeat. States with equal right languages are one, as words come sorted."""
        words = sorted({*words} - {b""})
        register: dict[tuple, int] = {}
        edges: list[dict[int, int]] = [{}]
        final = [False]
        path, last = [0], b""

        def settle(depth: int) -> None:
            while len(path) - 1 > depth:
                child = path.pop()
                sign = (final[child], tuple(edges[child].items()))
                same = register.setdefault(sign, child)
                edges[path[-1]][last[len(path) - 1]] = same

        for w in words:
            k = len(os.path.commonprefix((w, last)))
            settle(k)
            for b in w[k:]:
                edges.append({})
                final.append(False)
                edges[path[-1]][b] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = True
            last = w
        settle(0)
        number, order, stack = {0: 0}, [0], [0]
        while stack:
            for t in edges[stack.pop()].values():
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
                    stack.append(t)
        below: dict[int, int] = {}

        def count(s: int) -> int:
            todo = [s]
            while todo:
                x = todo[-1]
                if missing := [t for t in edges[x].values() if t not in below]:
                    todo += missing
                else:
                    below[x] = final[x] + sum(below[t] for t in edges[x].values())
                    todo.pop()
            return below[s]

        count(0)
        rows = []
        for s in order:
            n = 0
            for b in sorted(edges[s]):
                t = edges[s][b]
                rows.append((256 * number[s] + b, number[t], n))
                n += below[t]
        rows.sort()
        keys, to, adds = (np.array([r[k] for r in rows], t) for k, t in enumerate(cls.TYPES[:3]))
        ids = [encode(w) for w in words]
        at = np.r_[0, np.cumsum([len(x) for x in ids], dtype=np.int64)].astype("<i8")
        return cls({"keys": keys, "to": to, "adds": adds, "final": np.array([final[s] for s in order], "<i1"), "at": at, "ids": np.array([i for x in ids for i in x], "<u4")})

    def dump(self) -> bytes:
        arrays = [getattr(self, n) for n in self.NAMES]
        return struct.pack("<6q", *map(len, arrays)) + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        """Mapped into memory, so that the workers of a machine share it."""
        sizes = np.fromfile(path, "<i8", 6)
        at, out = 48, {}
        for name, kind, n in zip(cls.NAMES, cls.TYPES, sizes.tolist(), strict=True):
            out[name] = np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind)
            at += n * np.dtype(kind).itemsize
        return cls(out)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1; all words advance by one byte at a time."""
        out = np.full(len(words), -1, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat, offset = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        alive = np.flatnonzero(size > 0)
        state, number = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64)
        step = 0
        while len(alive) and len(self.keys):
            key = 256 * state + flat[offset[alive] + step]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[k] == key
            alive, k = alive[ok], k[ok]
            # A word that ends on the way comes before all that go on from there.
            number = number[ok] + self.adds[k] + (self.final[state[ok]] if step else 0)
            state = self.to[k].astype(np.int64)
            step += 1
            end = size[alive] == step
            won = end & (self.final[state] > 0)
            out[alive[won]] = number[won]
            alive, state, number = alive[~end], state[~end], number[~end]
        return out


def word_counts(docs: DataFrame, path: str, text_col: str = "text", most: int = LEXICON_BYTES) -> DataFrame:
    """(word, n): how often words of at most so many bytes occur in all texts, as UTF-8.

    Whole texts are counted, by what stands between blanks; each distinct such string is then split into words once.
    (Where several blanks meet, their own words are counted otherwise than they are encoded; only the choice of frequent
    words depends on it.)
    """
    packed = pretoken.character_classes(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for x in batch.column(0):
                found.update((x.as_py() or "").split(" "))
                if len(found) > COUNTED:
                    yield words_of(found)
                    found.clear()
        yield words_of(found)

    def words_of(found: Counter[str]) -> pa.RecordBatch:
        n: dict[str, int] = {}
        rows = ((k, f" {x}") for x, k in found.items())
        for group in pretoken.parts(rows, ""):
            joined, at, ranges = pretoken.split(group, packed)
            for part, (lo, hi) in zip(group, ranges, strict=True):
                for w in range(lo, hi):
                    x = joined[at[w] : at[w + 1]]
                    n[x] = n.get(x, 0) + part.row
        words = [w.encode("utf-8", "surrogatepass") for w in n]
        fit = pa.array([len(w) <= most for w in words], pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"]).filter(fit)

    return docs.select(F.col(text_col)).mapInArrow(tidied(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ship(docs: DataFrame, lexicon: Lexicon) -> str:
    """Put the lexicon into the shared folder, for Spark to bring to each executor; returns its name there."""
    spark, target = docs.sparkSession, workspace(docs.sparkSession, "lexicon") + ".bin"
    put(spark, target, lexicon.dump())
    spark.sparkContext.addFile(target)
    return target.rpartition("/")[2]


@functools.lru_cache(2)
def _opened(name: str) -> Lexicon:
    return Lexicon.open(SparkFiles.get(name))


class Encoder:
    """The ids of words: from the lexicon, else merged."""

    def __init__(self, path: str, lexicon: Lexicon):
        self.merges, self.lexicon, self.known, self.size = merges(path), lexicon, {}, 0
        self.flat, self.at = memoryview(lexicon.ids).cast("B") if len(lexicon.ids) else b"", lexicon.at  # not copied

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """A table of the ids, as little-endian 32-bit integers, that holds at least these words."""
        if self.size > REMEMBERED:
            self.known, self.size = {}, 0
        new = [w for w in {*words} if w not in self.known]
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        number = self.lexicon.find(raw)
        begin, end = (4 * self.at[np.maximum(number, 0) + k] for k in (0, 1)) if len(self.at) > 1 else (number, number)
        rest = iter(self.merges.encode_all([x for x, k in zip(raw, number.tolist(), strict=True) if k < 0]))
        for w, k, a, b in zip(new, number.tolist(), begin.tolist(), end.tolist(), strict=True):
            ids = self.known[w] = bytes(self.flat[a:b]) if k >= 0 else next(rest)
            self.size += len(w) + len(ids) + OVERHEAD
        return self.known


def decode(ids: bytes, m: Merges) -> bytes:
    """The bytes of ids (little-endian 32-bit integers); special tokens are not left out."""
    return b"".join(map(m.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def frequent(counts: DataFrame, words: int) -> DataFrame:
    """About `words` of the most frequent words of (word, n), without those that occur once.

    Counts are parted at eighths of their powers of two. Of the part in which the limit falls, words stay by their hash, so
    that no task has to order all words, nor many of each task's.
    """
    part = F.floor(8 * F.log2(F.col("n"))).cast("int")
    at = materialize(counts.where("n > 1"), "word-counts").withColumn("part", part)
    above, cut, share = 0, -1, 0
    for r in at.groupBy("part").count().orderBy(F.desc("part")).collect():  # at most 8 * 64
        if above + r["count"] > words:
            cut, share = r["part"], (words - above << 20) // r["count"]
            break
        above += r["count"]
    drawn = (F.col("part") == cut) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share)
    return at.where((F.col("part") > cut) | drawn).select("word", "n")


def compile_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS, text_col: str = "text") -> Lexicon:
    """Of about so many of the most frequent words of all texts; `words` bounds what reaches the driver."""
    top = frequent(word_counts(docs, path, text_col), words).orderBy(F.desc("n"), "word").limit(words).select("word").toArrow()
    return Lexicon.compile(top.column(0).to_pylist(), merges(path).encode)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256), and ids (binary) and decoded if `with_ids`, for each row of docs.

    Ids are those of the tokenizers library for the vocabulary file at path, without tokens added at the ends; special
    strings in a text give special tokens, as by its default. Digests are of the ids as little-endian 32-bit integers
    and of the decoded text in UTF-8. Null counts as empty, and empty texts have no tokens. Rows may repeat; other columns
    are ignored; an empty table gives no rows.
    """
    importable(docs.sparkSession)
    packed = pretoken.character_classes(path)
    name = ship(docs, compile_lexicon(docs, path, lexicon_words, text_col))
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(path)
        encoder = Encoder(path, _opened(name))
        special = struct.pack("<I", m.special_id)
        for batch in batches:
            keys, texts = batch.column(0), (x.as_py() or "" for x in batch.column(1))
            n, sha, dec, ids, raw = 0, hashlib.sha256(), _Utf8Digest(), [], []
            out: list[tuple] = []
            for group in pretoken.parts(enumerate(texts), m.special):
                joined, at, ranges = pretoken.split(group, packed)
                words = [*map(joined.__getitem__, map(slice, at, at[1:]))]
                del joined, at
                of = encoder.learn(words).__getitem__
                for part, (lo, hi) in zip(group, ranges, strict=True):
                    got = special * part.special + b"".join(map(of, words[lo:hi]))
                    n += len(got) // 4
                    sha.update(got)
                    back = decode(got, m)
                    dec.update(back)
                    if with_ids:
                        ids.append(got)
                        raw.append(back)
                    if part.last:
                        out.append((n, sha.hexdigest(), dec.hexdigest(), b"".join(ids), b"".join(raw).decode("utf-8", "replace")))
                        n, sha, dec, ids, raw = 0, hashlib.sha256(), _Utf8Digest(), [], []
            columns = [*zip(*out)] if out else [()] * 5  # noqa: B905
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)][: 5 if with_ids else 3]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 1 + len(arrays)]
            yield pa.RecordBatch.from_arrays([keys, *arrays], names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidied(run), schema)


class _Utf8Digest:
    """SHA-256 of bytes after they are read as UTF-8; parts end where a piece does, so where a character does."""

    def __init__(self):
        self.sha = hashlib.sha256()

    def update(self, raw: bytes) -> None:
        self.sha.update(raw.decode("utf-8", "replace").encode())

    def hexdigest(self) -> str:
        return self.sha.hexdigest()
