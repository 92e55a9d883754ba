"""Removal of long repeated byte strings over a sparse enhanced suffix array.

Anchors are chosen by content: of the grams in every string of the length in question the one with the least hash, so
that equal strings hold the same anchor at the same place. Anchors that occur once are done with. The others send their
surroundings (as much as a string of that length can reach) to the bucket of the anchor's hash, where they form a sorted
suffix array with common-prefix lengths. A stack scan walks its interval tree bottom-up; in each interval, occurrences
are kept in the order of what stands to their left, and only those newly next to each other in that order can extend
each other's match further: where left extensions are diverse, a run of occurrences that share one is a maximal repeat.
The result is either how far the repeats through each occurrence reach to both sides, or the repeats themselves, each
with all its occurrences.

An anchor that occurs very often is replaced by the strings whose anchor it is. These go the same way: those that occur
once are done with, and of the others a block sends each once, to be compared byte by byte with its equals. So no bucket
gets more than a bounded number of surroundings of one anchor.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .shared import importable, materialize

#: Bytes of an anchor's gram, and of the texts in a block.
GRAM = 32
BLOCK_BYTES = 1_500_000
#: Buckets of surroundings for each of other things, as a message of these is so much larger.
FINER = 8
#: An anchor that occurs more often than this is replaced by its strings.
HOT = 20_000
#: Anchors whose surroundings are spelt out at once: a block may have a hot string at each of its bytes.
AT_ONCE = 10_000
#: Strings whose anchors are looked for at once, so that hashes stay in a processor's cache.
STARTS = 20_000
#: Stands for what lies beyond a text; UTF-8 never has it.
NONE = 0xFF

_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place on: hashes of 1, 2, 4, ... bytes, put together."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h, part, have, out, used = raw.astype(np.uint64) + np.uint64(1), _P, 1, None, 0
        while True:
            if size & have:
                out = h[used : used + n] if out is None else _mix(out) * _P + h[used : used + n]
                used += have
            if used == size:
                return _mix(out)
            h = h[:-have] * part + h[have:]
            part, have = part * part, 2 * have


def _own_anchors(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where strings of `length` bytes start that lie in one text, the places of their anchors, hashes of all grams)."""
    gram = min(GRAM, length)
    n, width = len(raw) - length + 1, length - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bits = np.uint64(32)  # as many for every block, so that all choose alike
    h, own = np.empty(len(raw) - gram + 1, np.uint64), np.empty(n, np.int64)
    for lo in range(0, n, STARTS):
        part = gram_hashes(raw[lo : lo + STARTS + length - 1], gram)
        h[lo : lo + len(part)] = part
        least, have = (part >> bits << bits) | np.arange(len(part), dtype=np.uint64), 1  # of equal hashes the first is least
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if width > have:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        own[lo : lo + len(least)] = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + lo
    begins = np.r_[0, ends[:-1]]
    inside = np.zeros(n + 1, np.int32)
    full = ends - begins >= length
    np.add.at(inside, begins[full], 1)
    np.add.at(inside, ends[full] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    return start, own[start], h


def anchors(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all strings of `length` bytes that lie in one text."""
    _, at, h = _own_anchors(raw, ends, length)
    at = np.unique(at)
    return at, h[at]


def _around(raw: np.ndarray, ends: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, ends, shifts) of the pieces of texts that strings of `length` bytes with these anchors (sorted) can cover, and
    how far each piece was from where it is now."""
    text = np.searchsorted(ends, at, "right")
    lo, hi = np.maximum(np.r_[0, ends[:-1]][text], at - (length - min(GRAM, length))), np.minimum(ends[text], at + length)
    first = np.flatnonzero(np.r_[True, lo[1:] >= hi[:-1]]) if len(at) else at
    lo, hi = lo[first], hi[np.r_[first[1:] - 1, len(at) - 1]] if len(at) else hi
    ends = np.cumsum(hi - lo)
    shifts = hi - ends
    return raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(shifts, hi - lo)], ends, shifts


def strings_of(raw: np.ndarray, ends: np.ndarray, hot: np.ndarray, length: int) -> Anchors:
    """The strings whose anchors are at these places (sorted), as anchors of their own. Only what is around these is looked at."""
    raw, ends, shifts = _around(raw, ends, hot, length)
    start, own, _ = _own_anchors(raw, ends, length)
    shift = shifts[np.searchsorted(ends, start, "right")]
    chosen = np.isin(own + shift, hot)
    with np.errstate(over="ignore"):
        h = _mix(gram_hashes(raw, length)[start[chosen]] + np.uint64(length) * _P)
    start, own, shift = start[chosen], own[chosen], shift[chosen]
    return Anchors(start + shift, np.full(len(start), length), own - start, h)


def surroundings(raw: np.ndarray, ends: np.ndarray, at: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Rows of bytes: for each anchor what a string of `length` bytes through it can cover, with NONE beyond that and its
    text."""
    left = length - min(GRAM, length)
    padded = np.concatenate([np.full(left, NONE, np.uint8), raw, np.full(length, NONE, np.uint8)])
    rows = sliding_window_view(padded, left + length)[at].copy()
    text = np.searchsorted(ends, at, "right")
    before, after = np.minimum(at - np.r_[0, ends[:-1]][text], length - size), ends[text] - at
    near = np.flatnonzero(before < left)
    rows[near] = np.where(np.arange(left + length) < (left - before[near])[:, None], NONE, rows[near])
    near = np.flatnonzero(after < length)
    rows[near] = np.where(np.arange(left + length) >= (left + after[near])[:, None], NONE, rows[near])
    return rows


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows, the length of their common prefix of text."""
    differ = (a != b) | (a == NONE)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


#: Called with the left and right reach of a maximal repeat and all rows in which it occurs.
Emit = Callable[[int, int, list[int]], None]


def maximal_repeats(rows: np.ndarray, anchor: np.ndarray, left: int, length: int, emit: Emit | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How far (to the left, to the right) of its anchor each distinct row's repeats of `length` bytes reach, else 0, 0.

    rows: left context and right context; anchor: what must be equal for rows to be compared. emit gets the repeats of
    several rows.
    """
    n = len(rows)
    far_l, far_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return far_l, far_r
    right, back = np.ascontiguousarray(rows[:, left:]), np.ascontiguousarray(rows[:, :left][:, ::-1])
    key = np.concatenate([anchor.astype(">u8").view(np.uint8).reshape(n, 8), right], 1)
    order = np.argsort(key.view(f"S{8 + right.shape[1]}").reshape(n), kind="stable")
    group = anchor[order]
    same = group[1:] == group[:-1]
    lcp = np.zeros(n - 1, np.int64)
    for a in range(0, n - 1, 100_000):
        b = min(n - 1, a + 100_000)
        lcp[a:b] = _common(right[order[a:b]], right[order[a + 1 : b + 1]])
    lcp[~same] = -1
    edge = np.flatnonzero(np.r_[True, ~same, True])
    sizes = np.diff(edge)
    # Groups of two are one interval each.
    two = edge[:-1][sizes == 2]
    if len(two):
        x, y, r = order[two], order[two + 1], lcp[two]
        a = _common(back[x], back[y]) if left else np.zeros(len(two), np.int64)
        ok = a + r >= length
        for k in (x[ok], y[ok]):
            far_l[k], far_r[k] = a[ok], r[ok]
        if emit:
            for i, j, p, q in zip(*(z[ok].tolist() for z in (a, r, x, y)), strict=True):
                emit(i, j, [p, q])
    for lo, size in zip(edge[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        _interval_tree(order[lo : lo + size].tolist(), lcp[lo : lo + size - 1].tolist(), back, length, far_l, far_r, emit)
    return far_l, far_r


def _interval_tree(suffixes: list[int], lcp: list[int], back: np.ndarray, length: int, far_l: np.ndarray, far_r: np.ndarray, emit: Emit | None = None) -> None:
    """Scan a group's suffix array with a stack of open intervals; an interval's occurrences are merged when it closes."""
    lefts = [back[s].tobytes() for s in suffixes]
    rank = sorted(range(len(suffixes)), key=lefts.__getitem__)
    place = {s: k for k, s in enumerate(rank)}
    width = back.shape[1]

    def shared(i: int, j: int) -> int:
        """How much of what stands to the left of two occurrences is equal: their left extension."""
        a, b = lefts[i], lefts[j]
        lo, hi = 0, width
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if a[:mid] == b[:mid]:
                lo = mid
            else:
                hi = mid - 1
        end = a.find(b"\xff", 0, lo)
        return lo if end < 0 else end

    def meet(i: int, j: int, r: int) -> bool:
        a = shared(rank[i], rank[j])
        if a + r < length:
            return False
        for s in (suffixes[rank[i]], suffixes[rank[j]]):
            far_l[s], far_r[s] = max(far_l[s], a), max(far_r[s], r)
        return True

    def merge(one: list[int], two: list[int], r: int) -> list[int]:
        """Occurrences by the order of their left sides. Left extensions are diverse where neighbours differ; each new
        pair of neighbours shares r bytes to the right at least, and no other pair shares more to the left."""
        if len(one) < len(two):
            one, two = two, one
        met = False
        for x in two:
            k = bisect.bisect_left(one, x)
            if k:
                met |= meet(one[k - 1], x, r)
            if k < len(one):
                met |= meet(x, one[k], r)
            one.insert(k, x)
        if met and emit:
            fresh[r] = {*fresh.get(r, ()), *two}
        return one

    fresh: dict[int, set[int]] = {}  # of the open intervals, those that came to others since they were last reported

    def report(members: list[int], r: int) -> None:
        """An interval is whole: each run of its occurrences that share a left extension, and of which one is new to
        another (so that they don't all go on alike to the right), is a maximal repeat."""
        new = fresh.pop(r, None)
        if not new:
            return
        a = [shared(rank[i], rank[j]) for i, j in zip(members, members[1:])]  # noqa: B905
        runs: set[tuple[int, int]] = set()
        for k, x in enumerate(members):
            for at in (k - 1, k) if x in new else ():
                if not 0 <= at < len(a):
                    continue
                lo = hi = at
                level = a[at]
                while level + r >= length:
                    while lo and a[lo - 1] >= level:
                        lo -= 1
                    while hi + 1 < len(a) and a[hi + 1] >= level:
                        hi += 1
                    if (lo, hi) in runs:
                        break
                    runs.add((lo, hi))
                    emit(level, r, [suffixes[rank[m]] for m in members[lo : hi + 2]])
                    # The next run that holds this one shares less to the left.
                    level = max(a[lo - 1] if lo else -length, a[hi + 1] if hi + 1 < len(a) else -length)

    def close(stack: list[tuple[int, list[int]]]) -> None:
        r, members = stack.pop()
        below, rest = stack.pop()
        members = merge(rest, members, r)
        if emit and below < r:  # else more of the same interval is to come
            report(members, r)
        stack.append((below, members))

    stack: list[tuple[int, list[int]]] = []  # (common prefix with what stands before on the stack, occurrences)
    for k in range(len(suffixes)):
        now = [place[k]]
        depth = lcp[k - 1] if k else -1
        # Intervals deeper than this boundary close, the deepest first.
        while len(stack) > 1 and stack[-1][0] > depth:
            close(stack)
        stack.append((depth, now))
    while len(stack) > 1:
        close(stack)


# Messages


def _counter(hot: int):
    def reduce(payloads: list[bytes]) -> list[bytes]:
        """Of each hash that a block sent: 0 if it occurs once in all blocks, 1 if more often, 2 if more than `hot` times."""
        sent = [blocks.unsqueeze(p, "<u8", "<u4") for p in payloads]
        hashes, where = np.unique(np.concatenate([h for h, _ in sent]), return_inverse=True)
        total = np.bincount(where, np.concatenate([n for _, n in sent]), len(hashes))
        kind = ((total > 1).astype(np.uint8) + (total > hot))[where]
        ends = np.cumsum([len(h) for h, _ in sent])
        return [zstandard.compress(x.astype(np.uint8).tobytes(), 1) for x in np.split(kind, ends[:-1])]

    return reduce


class _Bucket:
    """The distinct surroundings that blocks sent to a bucket, and which of them each block's are."""

    def __init__(self, payloads: list[bytes], length: int):
        self.left = length - min(GRAM, length)
        hashes, rows, times, bases = [], [], [], []
        for p in payloads:
            h, n, base, flat = blocks.unsqueeze(p, "<u8", "<u4", "<u1", "<u1")
            hashes.append(h)
            times.append(n)
            bases.append(base)
            rows.append(flat.reshape(len(h), self.left + length))
        self.ends = np.cumsum([*map(len, hashes)])
        h, n, base, rows = map(np.concatenate, (hashes, times, bases, rows))
        first: dict[bytes, int] = {}
        # An anchor is the same where its base is too.
        where = np.fromiter((first.setdefault(base[k].tobytes() + rows[k].tobytes(), k) for k in range(len(h))), np.int64, len(h))
        own, self.where = np.unique(where, return_inverse=True)
        self.total = np.bincount(self.where, n, len(own))
        self.base, self.rows = base[own], rows[own]
        with np.errstate(over="ignore"):
            self.anchor = h[own] + self.base.astype(np.uint64)
        # What occurs several times with all its surroundings is a repeat as far as its text goes.
        behind, ahead = self.rows[:, : self.left][:, ::-1], self.rows[:, self.left :]
        self.whole_l, self.whole_r = _common(behind, behind), _common(ahead, ahead)
        self.often = (self.total > 1) & (self.whole_l + self.whole_r >= length)


def _reach(length: int):
    def reduce(payloads: list[bytes]) -> list[bytes]:
        b = _Bucket(payloads, length)
        far_l, far_r = maximal_repeats(b.rows, b.anchor, b.left, length)
        far_l[b.often], far_r[b.often] = b.whole_l[b.often], b.whole_r[b.often]
        return [blocks.squeeze(x.astype("<u2"), y.astype("<u2")) for x, y in zip(*(np.split(z[b.where], b.ends[:-1]) for z in (far_l, far_r)), strict=True)]

    return reduce


def _told_by(string: np.ndarray, place: int, length: int) -> bool:
    """Whether the gram at a place of a string is the anchor of some string of `length` bytes within it, and so an anchor
    wherever the string occurs."""
    gram = min(GRAM, length)
    h = gram_hashes(string, gram) >> np.uint64(32)
    width = length - gram + 1
    for lo in range(max(0, place - width + 1), min(place, len(h) - width) + 1):
        if lo + int(h[lo : lo + width].argmin()) == place:
            return True
    return False


def _repeats(length: int):
    def reduce(payloads: list[bytes]) -> list[bytes]:
        """To each block, for each repeat that its surroundings have: which of them, the repeat's digest, and its reach."""
        b = _Bucket(payloads, length)
        found: list[tuple[int, int, int, bytes]] = []

        def emit(a: int, r: int, members: list[int]) -> None:
            row = b.rows[members[0]]
            string = row[b.left - a : b.left + r]
            if _told_by(string, a + int(b.base[members[0]]), length):
                digest = hashlib.blake2b(string.tobytes(), digest_size=16).digest()
                found.extend((m, a, r, digest) for m in members)

        maximal_repeats(b.rows, b.anchor, b.left, length, emit)
        for k in np.flatnonzero(b.often).tolist():
            emit(int(b.whole_l[k]), int(b.whole_r[k]), [k])
        found.sort(key=lambda x: x[0])
        who = np.array([x[0] for x in found], np.int64)
        out = []
        for part in np.split(b.where, b.ends[:-1]):
            lo, hi = np.searchsorted(who, part), np.searchsorted(who, part, "right")
            at = [j for a, z in zip(lo.tolist(), hi.tolist(), strict=True) for j in range(a, z)]
            digests = np.frombuffer(b"".join(found[j][3] for j in at), "<u8") if at else np.zeros(0, "<u8")
            out.append(blocks.squeeze(np.repeat(np.arange(len(part)), hi - lo).astype("<u4"), np.array([found[j][1] for j in at], "<u2"), np.array([found[j][2] for j in at], "<u2"), digests))
        return out

    return reduce


def _anchor_messages(n: int):
    def messages(hashes: bytes) -> Iterable[blocks.Message]:
        h, times = np.unique(np.frombuffer(hashes, "<u8"), return_counts=True)
        for k, part in blocks.by_bucket(h, n):
            yield k, blocks.squeeze(h[part], times[part].astype("<u4"))

    return messages


def _kinds(hashes: bytes, got: list[dict] | None) -> np.ndarray:
    """The kind of each anchor of a block, from the buckets' answers."""
    h = np.frombuffer(hashes, "<u8")
    own, where = np.unique(h, return_inverse=True)
    kinds = b"".join(zstandard.decompress(x["payload"]) for x in sorted(got or [], key=lambda x: x["bucket"]))
    return np.frombuffer(kinds, np.uint8)[where] if len(own) else np.zeros(0, np.uint8)


def _open(body: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.decompress(body), np.uint8), np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))


class Anchors(NamedTuple):
    """Of a block: where they are, of how many bytes, where in them is the gram from which they grew, and their hashes."""

    places: np.ndarray
    sizes: np.ndarray
    bases: np.ndarray
    hashes: np.ndarray

    TYPES = ("<u4", "<u1", "<u1", "<u8")

    def pack(self, keep: np.ndarray | None = None) -> dict[str, bytes]:
        return {name: (x if keep is None else x[keep]).astype(t).tobytes() for name, x, t in zip(self._fields, self, Anchors.TYPES, strict=True)}

    @classmethod
    def unpack(cls, packed: list[dict]) -> Anchors:
        columns = [np.concatenate([np.frombuffer(x[name], t) for x in packed]) for name, t in zip(cls._fields, cls.TYPES, strict=True)]
        return cls(*(x.astype(np.int64) for x in columns[:3]), columns[3])


_FIELDS = "places binary, sizes binary, bases binary, hashes binary"
_STRUCT = pa.struct([(name, pa.binary()) for name in Anchors._fields])


def _settle(length: int):
    """Of a block's anchors, those that are shared and not hot, and (null if none) those that are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                block, mine, got = (c[k].as_py() for c in batch.columns)
                a, kinds = Anchors.unpack([mine]), _kinds(mine["hashes"], got)
                hot = (kinds == 2) & (a.sizes < length)
                rows = [a.pack((kinds > 0) & ~hot), a.pack(hot) if hot.any() else None]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], _STRUCT) for x in rows)], ["block", "shared", "hot"])

    return blocks.tidied(run)


def _spell(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                block, hot, body, sizes = (c[k].as_py() for c in batch.columns)
                raw, ends = _open(body, sizes)
                mine = strings_of(raw, ends, Anchors.unpack([hot]).places, length)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([mine.pack()], _STRUCT)], ["block", "mine"])

    return blocks.tidied(run)


def shared_anchors(table: DataFrame, length: int, hot: int) -> DataFrame:
    """(block, anchors): those that occur more than once; in place of those that do more than `hot` times, their strings."""

    def told(now: DataFrame) -> DataFrame:
        kinds = blocks.answer(blocks.ask(now.withColumn("hashes", F.col("mine.hashes")), ["hashes"], _anchor_messages(blocks.buckets(table))), _counter(hot))
        at = now.join(kinds, "block", "left").select("block", "mine", "got")
        return materialize(at.mapInArrow(_settle(length), f"block long, shared struct<{_struct()}>, hot struct<{_struct()}>"), "anchors")

    first = told(table.select("block", "mine"))
    more = first.where("hot IS NOT NULL").select("block", "hot")
    if more.isEmpty():
        return first.select("block", F.array("shared").alias("anchors"))
    spelt = more.join(table.select("block", "body", "sizes"), "block").mapInArrow(_spell(length), f"block long, mine struct<{_struct()}>")
    second = told(materialize(spelt, "strings")).select("block", F.col("shared").alias("strings"))
    return first.join(second, "block", "left").select("block", F.array_compact(F.array("shared", "strings")).alias("anchors"))


def _struct() -> str:
    return _FIELDS.replace(" ", ": ").replace(",: ", ", ")


def _distinct(raw: np.ndarray, ends: np.ndarray, a: Anchors, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, times, where, rows): an anchor of each distinct surroundings (with their base) of a block, by hash, how
    often they occur, which of them each anchor has, and themselves."""
    seen: dict[bytes, int] = {}
    h, base = a.hashes, a.bases.astype(np.uint8)
    where = np.zeros(len(h), np.int64)
    for lo in range(0, len(h), AT_ONCE):
        rows = surroundings(raw, ends, a.places[lo : lo + AT_ONCE], a.sizes[lo : lo + AT_ONCE], length)
        for k, row in enumerate(rows, lo):
            where[k] = seen.setdefault(h[k].tobytes()[::-1] + base[k].tobytes() + row.tobytes(), len(seen))
    keys = sorted(seen)  # in the order of hashes
    place = np.zeros(len(seen), np.int64)
    place[[seen[x] for x in keys]] = np.arange(len(seen))
    where = place[where]
    first = np.zeros(len(seen), np.int64)
    first[where] = np.arange(len(h))
    rows = np.frombuffer(b"".join(x[9:] for x in keys), np.uint8).reshape(len(seen), 2 * length - min(GRAM, length))
    return first, np.bincount(where, minlength=len(seen)), where, rows


def _context_messages(n: int, length: int):
    def messages(body: bytes, sizes: bytes, anchors: list[dict]) -> Iterable[blocks.Message]:
        raw, ends = _open(body, sizes)
        a = Anchors.unpack(anchors)
        first, times, _, rows = _distinct(raw, ends, a, length)
        h, base = a.hashes[first], a.bases[first].astype("<u1")
        for k, part in blocks.by_bucket(h, n):
            yield k, blocks.squeeze(h[part], times[part].astype("<u4"), base[part], np.ascontiguousarray(rows[part]).reshape(-1))

    return messages


def _stored(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """Blocks of texts, with their anchors."""
    kind = dict(docs.dtypes)[id_col]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = blocks.block_ids()
        for ids, texts in blocks.grouped(batches, BLOCK_BYTES):
            raw = b"".join(texts)
            sizes = np.fromiter(map(len, texts), "<u4", len(texts))
            at, h = anchors(np.frombuffer(raw, np.uint8), np.cumsum(sizes.astype(np.int64)), length)
            mine = Anchors(at, np.full(len(at), min(GRAM, length)), np.zeros(len(at), np.int64), h).pack()
            columns = [pa.array([next(number)], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([zstandard.compress(raw, 1)], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), pa.array([mine], _STRUCT)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "body", "sizes", "mine"])

    made = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(build, f"block long, ids array<{kind}>, body binary, sizes binary, mine struct<{_struct()}>")
    return blocks.store(made, "repeats")


def _judged(docs: DataFrame, id_col: str, text_col: str, length: int, hot: int, judge: Callable) -> DataFrame:
    """(ids, body, sizes, anchors, got) for each block: what `judge` answers for its anchors' surroundings."""
    if not 0 < length <= 255:
        raise ValueError("lengths go from 1 to 255 bytes")
    blocks.bounded(docs.sparkSession)
    table = _stored(docs, id_col, text_col, length)
    known = table.select("block", "ids", "body", "sizes").join(shared_anchors(table, length, hot), "block")
    fields = ["body", "sizes", "anchors"]
    answers = blocks.answer(blocks.ask(known, fields, _context_messages(FINER * blocks.buckets(table), length)), judge(length))
    return known.join(answers, "block", "left").select("ids", *fields, "got")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, hot: int = HOT) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept), a row for each row of docs; kept has the bytes that stay.

    Each byte covered by a string of `length` bytes (255 at most) that also starts elsewhere, in the same text or another,
    is removed; strings are judged on the input. hot bounds the work for one anchor, not the result. Texts are UTF-8
    bytes; null counts as empty; shorter texts lose nothing. Rows that repeat a text are copies of each other. A cut may
    leave part of a character. Other columns are ignored; an empty table gives no rows.
    """
    importable(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield _cut(*(c[k].as_py() for c in batch.columns), length=length, kind=batch.column(0).type.value_type, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return _judged(docs, id_col, text_col, length, hot, _reach).mapInArrow(blocks.tidied(finish), schema)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, hot: int = HOT) -> DataFrame:
    """(repeat, id_col, row, start, n_bytes): the maximal repeats of at least `length` bytes, each with all its occurrences.

    repeat is the digest of the string; row tells rows of docs apart that repeat an id; start is the byte in the text. A
    repeat is maximal if its occurrences don't all go on alike to a side, or if it goes on for as far as is compared: a
    string of `length` bytes to either side of an anchor. Longer strings come in overlapping pieces, one or more for each
    anchor in them. Nulls, short texts and empty tables as for dedup. The number of rows is that of all occurrences.
    """
    importable(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids, body, sizes, packed, got = (c[k].as_py() for c in batch.columns)
                raw, ends = _open(body, sizes)
                a = Anchors.unpack(packed)
                _, times, where, _ = _distinct(raw, ends, a, length)
                order = np.argsort(where, kind="stable")
                begin, at, out = np.cumsum(times) - times, 0, []
                for x in sorted(got or [], key=lambda x: x["bucket"]):
                    which, left, right, digests = blocks.unsqueeze(x["payload"], "<u4", "<u2", "<u2", "<u8")
                    out.append((which.astype(np.int64), left.astype(np.int64), right.astype(np.int64), digests.reshape(-1, 2), x["bucket"]))
                h = a.hashes[order[begin]] if len(times) else a.hashes
                begins = np.r_[0, ends[:-1]]
                slices = dict(blocks.by_bucket(h, n))
                found: set[tuple] = set()
                for which, left, right, digests, bucket in out:
                    at = slices[bucket].start
                    for j, x, y, d in zip(which.tolist(), left.tolist(), right.tolist(), digests, strict=True):
                        own = at + j
                        for m in order[begin[own] : begin[own] + times[own]].tolist():
                            place = int(a.places[m])
                            text = int(np.searchsorted(ends, place, "right"))
                            found.add((d.tobytes().hex(), text, place - x - int(begins[text]), x + y))
                rows = sorted(found)
                columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([ids[r[1]] for r in rows], batch.column(0).type.value_type), *(pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays(columns, ["repeat", id_col, "row", "start", "n_bytes"])

    n = FINER * blocks.buckets(docs)
    return _judged(docs, id_col, text_col, length, hot, _repeats).mapInArrow(blocks.tidied(run), f"repeat string, `{id_col}` {kind}, row long, start long, n_bytes long")


def _cut(ids, body, sizes, packed, got, *, length: int, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    raw, ends = _open(body, sizes)
    a = Anchors.unpack(packed)
    step = np.zeros(len(raw) + 1, np.int64)
    if len(a.places):
        _, _, where, _ = _distinct(raw, ends, a, length)
        parts = [blocks.unsqueeze(x["payload"], "<u2", "<u2") for x in sorted(got, key=lambda x: x["bucket"])]
        left, right = (np.concatenate(x).astype(np.int64)[where] for x in zip(*parts, strict=True))
        ok = right > 0
        np.add.at(step, a.places[ok] - left[ok], 1)
        np.add.at(step, a.places[ok] + right[ok], -1)
    gone = np.cumsum(step[:-1]) > 0
    begins = np.r_[0, ends[:-1]]
    n_removed, n_spans, sha, kept = [], [], [], []
    for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True):
        g = gone[lo:hi]
        rest = raw[lo:hi][~g].tobytes()
        n_removed.append(int(g.sum()))
        n_spans.append(int(np.count_nonzero(g[1:] & ~g[:-1]) + (len(g) > 0 and g[0])))
        sha.append(hashlib.sha256(rest).hexdigest())
        kept.append(rest)
    columns = [pa.array(ids, kind), pa.array((ends - begins), pa.int64()), *(pa.array(x, pa.int64()) for x in (n_removed, n_spans)), pa.array(sha, pa.string()), pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names)
