"""Near-duplicate join on word shingles: a MinHash LSH forest, and exact verification.

Each of the trees gives a text a signature of `DEPTH` hashes. Equal signatures' prefixes are runs of a tree's sorted
signatures, so that a sorted bucket is a trie; each bucket has all of its trees' branches below some beginnings. From
there every signature learns the longest prefix that it shares with another. Matching then starts with whole signatures
and shortens the prefix, one hash at a time, as the data ask: from the similarities of what was found at a length follows
how much must have been missed there, and once that is within the target recall, no shorter prefix is matched. The chance
of a pair of the least similarity gives the shortest prefix that can be needed.

Documents below one prefix are compared by sketches (a bit for each hash of their signatures), and only those that may
come near the similarity are joined, so that chance meetings of unlike texts chain nothing together. What is joined forms
components; those are verified pair by pair on their whole shingle sets, large ones in pairs of parts, without any pair
becoming a row. Texts with equal shingle sets are one class from the start, and its first document stands for it.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .components import connected_components
from .shared import importable, materialize, staying

WORDS = 5
SIMILARITY = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.99999
BLOCK_BYTES = 8_000_000
#: Documents of one prefix are joined if their sketches say a similarity of so many standard deviations below the wanted one.
#: At 0.8, a sketch of 256 bits is off by 0.0375 in 1 of 3 cases, so that 0.5 is enough.
DEVIATIONS = 8
#: In larger groups of one prefix, documents are compared with leaders only: those that aren't this near (or as near as is
#: wanted, if that is more) to any before. Similarities are one less a distance, so that of two texts of the wanted similarity
#: one leader is near to both; SLACK allows for what sketches err.
GROUP, LEADER, SLACK = 4_096, 0.8, 0.25
#: Documents, and bytes of shingles, that are verified together; larger components are split into parts of half that.
TOGETHER, TOGETHER_BYTES = 2_000, 64_000_000

#: The most ids with hashes of texts (16 bytes each) that are broadcast to drop rows; more take a shuffled join.
DROPPED_ROWS = 1_000_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def matched_depth(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which the forest finds a pair of this similarity with this probability; 1 at least."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def trees_for(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """TREES, or as many more as prefixes of one hash need to find a pair of this similarity with this probability."""
    if not 0 < similarity < 1 or not 0 < recall < 1:
        return TREES
    return max(TREES, math.ceil(math.log(1 - recall) / math.log(1 - similarity)))


def found_share(similarities: dict[float, int], depth: int, trees: int) -> float:
    """The share of all pairs that prefixes of this length find, from the similarities of those that they found: one that
    is found with probability q stands for 1 / q. Where none is found, nothing is known: 0."""
    whole = sum(n / (1 - (1 - min(s, 1) ** depth) ** trees) for s, n in similarities.items())
    return sum(similarities.values()) / whole if whole else 0.0


class Nearness(NamedTuple):
    """From which similarity of sketches on documents of one prefix are joined; a document needs no leader of its own; and is
    joined to a leader. Below what chance gives, everything is."""

    joined: float
    led: float
    leader: float


def nearness(similarity: float, bits: int) -> Nearness:
    joined = similarity - DEVIATIONS * math.sqrt((1 - similarity**2) / bits)
    led = max(LEADER, similarity)
    leader = similarity + led - 1 - SLACK
    return Nearness(*(x if x > 0 else -2.0 if k != 1 else x for k, x in enumerate((joined, led, leader))))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` words; fewer words, but not none, are one run."""
    known: dict[bytes, int] = {}
    out = []
    for x in texts:
        words = _WORD.findall(x.lower())
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(size, len(h))
        with np.errstate(over="ignore"):
            run = np.full(max(0, len(h) - n + 1) if n else 0, n, np.uint64)
            for k in range(n):
                run = _mix(run * _PRIME + h[k : k + len(run)])
        out.append(np.unique(run))
    return out


def signatures(sets: list[np.ndarray], trees: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """((texts, trees, depth) hashes of 16 bits, (texts, words) sketches of 64 bits a word); 0 for texts without shingles."""
    size = np.array([len(s) for s in sets])
    have = np.flatnonzero(size)
    out = np.zeros((len(sets), trees, depth), np.uint16)
    sketch = np.zeros((len(sets), -(-trees * depth // 64) * 8), np.uint8)
    if not len(have):
        return out, sketch.view("<u8")
    flat = (np.concatenate([sets[k] for k in have]) >> np.uint64(32)).astype(np.uint32)
    begin = np.cumsum(size[have]) - size[have]
    seeds = np.random.default_rng(20240229).integers(0, 2**32, (trees, depth, 2), np.uint32)
    bits = np.zeros((len(have), trees * depth), np.uint8)
    work = np.empty_like(flat)
    for t in range(trees):
        for d in range(depth):
            a, b = seeds[t, d]
            np.bitwise_xor(flat, b, out=work)
            np.multiply(work, a | np.uint32(1), out=work)
            least = np.minimum.reduceat(work, begin)
            least = (least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)  # small numbers, mixed
            out[have, t, d] = (least >> np.uint32(16)).astype(np.uint16)
            bits[:, t * depth + d] = (least * np.uint32(0x85EBCA6B) >> np.uint32(31)).astype(np.uint8)
    sketch[have, : -(-trees * depth // 8)] = np.packbits(bits, axis=1)
    return out, sketch.view("<u8")


def prefixes(signature: np.ndarray, depth: int) -> np.ndarray:
    """(texts, trees) keys of 64 bits, by tree, of the first `depth` hashes."""
    n, trees, _ = signature.shape
    key = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), (n, trees))
    for d in range(depth):
        key = _mix(key * _PRIME + signature[:, :, d].astype(np.uint64) + np.uint64(1))
    return key


def alike(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The similarity that sketches tell, of each of a (rows, words) with each of b."""
    apart = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        apart += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return 1 - 2 * apart / bits


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, 2): 128 bits of a hash of each set, in halves; 0 for empty sets."""
    out = np.zeros((len(sets), 2), np.uint64)
    for k, s in enumerate(sets):
        if len(s):
            out[k] = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<u8")
    return out


def _entries(keys: bytes, trees: int, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct (prefix, rest of the signature), sorted; whether the block has one twice; and which each has."""
    signature = np.frombuffer(keys, "<u2").reshape(-1, trees, DEPTH)
    key = prefixes(signature, floor).reshape(-1)
    rest = np.zeros((len(key), 1), np.uint64)
    for d in range(floor, DEPTH):
        rest = rest << np.uint64(8) | (signature[:, :, d].reshape(-1, 1) >> np.uint16(8)).astype(np.uint64)
    order = np.lexsort((rest[:, 0], key))
    k, r = key[order], rest[order, 0]
    new = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])] if len(k) else np.zeros(0, bool)
    where = np.empty(len(k), np.int64)
    where[order] = np.cumsum(new) - 1
    return k[new], r[new], np.bincount(where, minlength=int(new.sum())) > 1, where


def _whole(digests: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct digests, sorted, the first document that has each, and the halves of each document's."""
    flat = np.frombuffer(digests, "<u8").reshape(-1, 2)
    own, first = np.unique(flat.reshape(-1), return_index=True)
    return own[own > 0], first[own > 0] // 2, flat


def _messages(buckets: int, trees: int, floor: int):
    def messages(block: int, counts: bytes, keys: bytes, digests: bytes) -> Iterable[blocks.Message]:
        have = np.repeat(np.frombuffer(counts, "<u4") > 0, trees)
        k, r, twice, where = _entries(keys, trees, floor)
        real = np.bincount(where, have, len(k)) > 0  # texts without shingles have no place in a tree
        own, first, _ = _whole(digests)
        head, parts = block.to_bytes(8, "little"), dict(blocks.by_bucket(own, buckets))
        trees_of = dict(blocks.by_bucket(k, buckets))
        for bucket in sorted({*parts, *trees_of}):
            a, b = parts.get(bucket, slice(0, 0)), trees_of.get(bucket, slice(0, 0))
            state = twice[b].astype(np.uint8) + 2 * real[b].astype(np.uint8)
            yield bucket, head + blocks.squeeze(own[a], first[a].astype("<u4"), k[b], r[b], state)

    return messages


def _matched(floor: int):
    def reduce(payloads: list[bytes]) -> list[bytes]:
        """To each block, for each of its digests the least document that has it, and for each of its places in a tree
        the longest prefix (0: shorter than `floor`) that it shares with another: of the neighbours in sorted order."""
        sent = [(int.from_bytes(p[:8], "little"), *blocks.unsqueeze(p[8:], "<u8", "<u4", "<u8", "<u8", "<u1")) for p in payloads]
        k = np.concatenate([x[1] for x in sent])
        ref = np.concatenate([(np.int64(x[0]) << 20) + x[2].astype(np.int64) for x in sent])
        least = np.zeros(len(k), np.int64)
        if len(k):
            order = np.lexsort((ref, k))
            new = np.r_[True, k[order[1:]] != k[order[:-1]]]
            least[order] = ref[order[new]][np.cumsum(new) - 1]
        key, rest, state = (np.concatenate([x[j] for x in sent]) for j in (3, 4, 5))
        depth = np.where((state & 1) > 0, DEPTH, 0).astype(np.uint8)
        live = np.flatnonzero(state & 2)
        order = live[np.lexsort((rest[live], key[live]))]
        if len(order) > 1:
            same, apart = key[order[1:]] == key[order[:-1]], rest[order[1:]] ^ rest[order[:-1]]
            # A byte of the rest for each hash beyond the floor: how many of the first agree.
            shared = np.full(len(apart), floor, np.uint8)
            for d in range(floor, DEPTH):
                shared += apart < np.uint64(1) << np.uint64(8 * (DEPTH - 1 - d))
            shared = np.where(same, shared, 0).astype(np.uint8)
            for one in (order[1:], order[:-1]):
                depth[one] = np.maximum(depth[one], shared)
        depth[(state & 2) == 0] = 0
        cut = lambda x, j: np.split(x, np.cumsum([len(y[j]) for y in sent])[:-1])
        return [blocks.squeeze(a, b) for a, b in zip(cut(least, 1), cut(depth, 3), strict=True)]

    return reduce


def _know(trees: int, floor: int):
    """From the answers: for each document of a block the one that stands for its class, and how deep it is matched in
    each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                block, keys, digests, got = (c[k].as_py() for c in batch.columns)
                own, _, flat = _whole(digests)
                entries, _, _, where = _entries(keys, trees, floor)
                parts = [blocks.unsqueeze(x["payload"], "<i8", "<u1") for x in sorted(got or [], key=lambda x: x["bucket"])]
                least, depth = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
                ref = (np.int64(block) << 20) + np.arange(len(flat))
                stands = ref
                if len(own):  # should one half of two digests be equal by chance, the other tells
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    stands = np.where(flat > 0, least[at], ref[:, None]).max(1)
                matched = depth[where].reshape(-1, trees) if len(entries) else np.zeros((len(flat), trees), np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([stands.astype("<i8").tobytes()], pa.binary()), pa.array([matched.tobytes()], pa.binary())], ["block", "stands", "matched"])

    return blocks.tidied(run)


def _level_messages(buckets: int, trees: int, depth: int):
    """What a block's documents send that are matched to this depth: prefix, document, sketch."""

    def messages(block: int, keys: bytes, sketches: bytes, stands: bytes, matched: bytes) -> Iterable[blocks.Message]:
        signature = np.frombuffer(keys, "<u2").reshape(-1, trees, DEPTH)
        n = len(signature)
        first = np.frombuffer(stands, "<i8") == (np.int64(block) << 20) + np.arange(n)
        doc, tree = np.nonzero((np.frombuffer(matched, np.uint8).reshape(n, trees) >= depth) & first[:, None])
        if not len(doc):
            return
        key = prefixes(signature[np.unique(doc)], depth)[np.unique(doc, return_inverse=True)[1], tree]
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        sketch = np.frombuffer(sketches, "<u8").reshape(n, -1)
        for bucket, part in blocks.by_bucket(key, buckets):
            own, at = np.unique(doc[part], return_inverse=True)  # a sketch once for all of a document's trees here
            yield bucket, block.to_bytes(8, "little") + blocks.squeeze(key[part], at.astype("<u4"), own.astype("<u4"), sketch[own].reshape(-1))

    return messages


def _joined(ref: np.ndarray, sketch: np.ndarray, bits: int, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, nearness): enough pairs of one prefix's documents to connect all that may come near the similarity."""
    bound = nearness(similarity, bits)
    if len(ref) <= GROUP:
        near = alike(sketch, sketch, bits)
        np.fill_diagonal(near, -3)
        root = _roots(near >= bound.joined)
        k = np.flatnonzero(root != np.arange(len(ref)))
        return ref[k], ref[root[k]], near.max(1)[k]
    rest, out = np.arange(len(ref)), []
    while len(rest):
        near = np.concatenate([alike(sketch[k : k + 100_000], sketch[rest[:1]], bits)[:, 0] for k in range(0, len(ref), 100_000)])
        k = np.flatnonzero(near >= bound.leader)
        k = k[k != rest[0]]
        out.append((ref[k], np.full(len(k), ref[rest[0]]), near[k]))
        rest = rest[1:][near[rest[1:]] < bound.led]
        if bound.leader < 0:  # all are joined to the first
            break
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _edges(trees: int, similarity: float):
    bits, schema = trees * DEPTH, {"a": pa.int64(), "b": pa.int64(), "near": pa.int32()}

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Pairs of documents, once for each of the bucket's prefixes that joins them, with their nearness in hundredths."""
        keys, refs, sketches, place, at = [], [], [], [], 0
        for p in rows.column("payload").to_pylist():
            k, who, own, flat = blocks.unsqueeze(p[8:], "<u8", "<u4", "<u4", "<u8")
            keys.append(k)
            place.append(who.astype(np.int64) + at)
            refs.append((np.int64(int.from_bytes(p[:8], "little")) << 20) + own.astype(np.int64))
            sketches.append(flat.reshape(len(own), -1))
            at += len(own)
        k, place, ref, sketch = map(np.concatenate, (keys, place, refs, sketches))
        order = np.lexsort((ref[place], k))
        k, place = k[order], place[order]
        cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
        size, out, two = np.diff(cut), [], cut[:-1][np.diff(cut) == 2]
        one, other = place[two], place[two + 1]
        apart = np.bitwise_count(sketch[one] ^ sketch[other]).sum(1, dtype=np.int64)
        near = 1 - 2 * apart / bits
        ok = near >= nearness(similarity, bits).joined
        out.append((ref[one[ok]], ref[other[ok]], near[ok]))
        seen: set[bytes] = set()
        for lo, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = place[lo : lo + n]
            if (same := own.tobytes()) not in seen:  # many trees have the same group
                seen.add(same)
                out.append(_joined(ref[own], sketch[own], bits, similarity))
        a, b, near = (np.concatenate(x) for x in zip(*out, strict=True))
        blocks.tidy()
        return pa.table({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64()), "near": pa.array((100 * near).astype(np.int32), pa.int32())}, schema=pa.schema(schema))

    return run


def candidates(table: DataFrame, known: DataFrame, trees: int, floor: int, similarity: float, recall: float) -> tuple[DataFrame, int]:
    """((a, b) of documents to be verified together, the length of the prefix that was matched last)."""
    n, both = blocks.buckets(table), table.select("block", "keys", "sketches").join(known, "block").withColumn("own", F.col("block"))
    depth = DEPTH
    while True:
        asked = blocks.ask(both, ["own", "keys", "sketches", "stands", "matched"], _level_messages(n, trees, depth))
        edges = asked.groupBy("bucket").applyInArrow(_edges(trees, similarity), "a long, b long, near int")
        edges = materialize(edges.groupBy("a", "b").agg(F.max("near").alias("near")), "near")
        if depth <= floor:
            return edges, depth
        # At most a row for each hundredth. Sketches err to both sides, so that what is just below counts as just there.
        counts = edges.where(F.col("near") >= 100 * similarity - 4).groupBy(F.greatest("near", F.lit(int(100 * similarity))).alias("s")).count().collect()
        if found_share({r["s"] / 100: r["count"] for r in counts}, depth, trees) >= recall:
            return edges, depth
        depth -= 1


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: its number, the one that stands for its class, and how many shingles it has."""
    for batch in batches:
        for k in range(len(batch)):
            block, ids, counts, stands = (c[k].as_py() for c in batch.columns)
            columns = [pa.array(ids, batch.column(1).type.value_type), pa.array((np.int64(block) << 20) + np.arange(len(ids))), pa.array(np.frombuffer(stands, "<i8")), pa.array(np.frombuffer(counts, "<u4").astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ref", "stands", "n_shingles"])


def _roots(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the least row that it reaches."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(1, initial=len(links))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """A boolean matrix: which pairs of distinct sets have at least this Jaccard similarity."""
    m, size = len(sets), np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(m), size)
    shared, where, often = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.zeros((m, m), np.float32)
    column = np.cumsum(often > 1) - 1
    keep = often[where] > 1
    who, where = who[keep], column[where[keep]]
    order = np.argsort(where, kind="stable")
    who, where = who[order], where[order]
    width = int((often > 1).sum())
    step = max(256, min(width, 16_000_000 // max(m, 1)))
    for lo in range(0, width, step):
        a, b = np.searchsorted(where, [lo, lo + step])
        part = np.zeros((m, step), np.float32)
        part[who[a:b], where[a:b] - lo] = 1
        common += part @ part.T
    either = size[:, None] + size[None, :] - common
    out = common >= similarity * either - 1e-6
    np.fill_diagonal(out, False)
    return out


def _verify(similarity: float):
    def emit(refs: list[int], parts: list[int], sets: list[np.ndarray], unit: tuple) -> pa.RecordBatch:
        order = np.argsort(refs)
        refs, parts, sets = np.array(refs)[order], np.array(parts)[order], [sets[k] for k in order]
        links = linked(sets, similarity)
        root = refs[_roots(links)]
        if unit[1] != unit[2]:  # pairs within a part are counted where that part is alone
            links &= parts[:, None] != parts[None, :]
        return pa.RecordBatch.from_arrays([pa.array(refs), pa.array(root), pa.array(links.sum(1).astype(np.int64))], ["ref", "root", "n_links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[k].as_py() for c in b.columns) for b in batches for k in range(len(b)))
        for unit, members in itertools.groupby(rows, key=lambda r: r[:3]):
            refs, parts, sets = [], [], []
            for r in members:
                refs.append(r[3])
                parts.append(r[4])
                sets.append(np.frombuffer(r[5], "<u8"))
            yield emit(refs, parts, sets, unit)

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(id_col, class_id, class_size, n_links, n_shingles, stands) for each row of docs.

    A link joins two texts whose sets of shingles (runs of five words; words are runs of digits, letters with A-Z folded
    and non-ASCII characters) differ and have at least this Jaccard similarity. n_links counts a row's links, texts with
    equal sets as one. class_id is the least id of all rows that links and equal sets lead to, class_size their number;
    stands is true for one row of each class: that with the least id, of rows that repeat it any one. Texts of fewer than
    five words have one shingle; null, empty and wordless texts have none, no link, and are classes of their own, named
    by their own ids. A null id takes part, and its class is named by another's id if there is one. Other columns are
    ignored; an empty table gives no rows. Two sets below the similarity never link; of all pairs that should, a
    share of 1 - recall may be missed, those nearest to the similarity first. Small similarities take more trees, and more
    documents of one prefix are verified: at 0.3, all.
    """
    importable(docs.sparkSession)
    trees = trees_for(similarity, recall)
    kind, n, floor = dict(docs.dtypes)[id_col], blocks.buckets(docs), matched_depth(similarity, trees, DEPTH, recall)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = blocks.block_ids()
        for ids, texts in blocks.grouped(batches, BLOCK_BYTES):
            sets = shingles(texts)
            signature, sketch = signatures(sets, trees)
            fields = {
                "body": zstandard.compress(b"".join(texts), 1), "sizes": np.array([len(x) for x in texts], "<u4").tobytes(), "counts": np.array([len(s) for s in sets], "<u4").tobytes(),
                "keys": signature.astype("<u2").tobytes(), "sketches": sketch.tobytes(), "digests": _digests(sets).astype("<u8").tobytes(),
            }
            yield pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)), *(pa.array([x], pa.binary()) for x in fields.values())], ["block", "ids", *fields])

    fields = "body binary, sizes binary, counts binary, keys binary, sketches binary, digests binary"
    table = blocks.store(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(build, f"block long, ids array<{kind}>, {fields}"), "forest")
    asked = blocks.ask(table.withColumn("own", F.col("block")), ["own", "counts", "keys", "digests"], _messages(n, trees, floor))
    told = table.select("block", "keys", "digests").join(blocks.answer(asked, _matched(floor)), "block", "left").select("block", "keys", "digests", "got")
    known = materialize(told.mapInArrow(_know(trees, floor), "block long, stands binary, matched binary"), "matched")
    found = table.select("block", "ids", "counts").join(known, "block").select("block", "ids", "counts", "stands")
    found = materialize(found.mapInArrow(_documents, f"id {kind}, ref long, stands long, n_shingles long"), "documents")

    edges, _ = candidates(table, known, trees, floor, similarity, recall)
    groups = materialize(connected_components(edges, "a", "b"), "candidates")
    sizes = groups.join(found.select(F.col("ref").alias("node"), "n_shingles"), "node").groupBy("component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    parts = F.ceil(F.greatest(F.col("m") / TOGETHER, F.col("s") * 8 / TOGETHER_BYTES)).cast("int")
    # One part if all fits; else parts of half as much, of which two are together.
    sizes = materialize(sizes.select("component", F.when(parts == 1, 1).otherwise(2 * parts).alias("p")), "candidate-sizes")
    wanted = groups.join(sizes, "component").groupBy(F.shiftright("node", 20).alias("block")).agg(F.collect_list(F.struct("node", "component", "p")).alias("wanted"))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                body, sizes, want = (c[k].as_py() for c in batch.columns)
                raw, ends = zstandard.decompress(body), np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))
                out: list[tuple] = []
                at = [x["node"] & 0xFFFFF for x in want]
                for x, s in zip(want, shingles([raw[(ends[i - 1] if i else 0) : ends[i]] for i in at]), strict=True):
                    part = int(x["node"] * 0x9E3779B1 >> 7) % x["p"]
                    out += [(x["component"], min(part, j), max(part, j), x["node"], part, s.tobytes()) for j in range(x["p"])]
                columns = [*zip(*out)] if out else [()] * 6  # noqa: B905
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["component", "i", "j", "ref", "part", "shingles"])

    sent = table.select("block", "body", "sizes").join(wanted, "block").select("body", "sizes", "wanted")
    sent = sent.mapInArrow(ship, "component long, i int, j int, ref long, part int, shingles binary")
    sent = sent.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = materialize(sent.mapInArrow(_verify(similarity), "ref long, root long, n_links long"), "links")
    counted = links.groupBy("ref").agg(F.sum("n_links").alias("n_links"), F.min("root").alias("root"))
    if not sizes.where("p > 1").isEmpty():  # what several units found of a component is put together
        whole = connected_components(links.select("ref", "root"), "ref", "root")
        counted = counted.drop("root").join(whole.withColumnRenamed("component", "root").withColumnRenamed("node", "ref"), "ref", "left")
    out = found.join(counted.select(F.col("ref").alias("stands"), "n_links", "root"), "stands", "left")
    out = materialize(out.select("id", "ref", F.coalesce("root", "stands").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_shingles"), "classes")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "ref")))
    named = materialize(out.groupBy("root").agg(first.alias("first"), F.min("ref").alias("any"), F.count("*").alias("class_size")), "class-names")
    return out.join(named, "root").select(
        F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "class_size", "n_links", "n_shingles", (F.col("ref") == F.coalesce("first.ref", "any")).alias("stands")
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their class: one of each.

    It is one with the least id, or without an id if none has one. Rows that repeat an id are judged each by its own
    text; of rows that repeat both, any one.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), key.alias("key")).alias("id"), F.col(text_col).alias("text"))
    pairs = classes(rows, "id", "text", similarity).groupBy("id.id", "id.key").agg(F.count("*").alias("n"), F.sum(F.col("stands").cast("long")).alias("m"))
    return staying(docs, [F.col(id_col), key], pairs, DROPPED_ROWS)
