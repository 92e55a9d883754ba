"""Token counts by a finite-state transducer.

Byte-pair merges have a left-to-right form: the encoding of a longer prefix is that of a shorter one and one more token,
and the last token is the only one that is a suffix and stays apart from the token before it when both are merged
alone. What decides all that follows is bounded: the longest suffix that begins some token, and the last tokens (and
counts) at the places in it. These are the states; each transition, on a byte, carries the change of the number of
tokens. States are compiled when first reached. Where a piece starts, the machine returns to its first state.

A text is cut into chunks, wherever they end. A chunk's map leads from entry states to exit states and the tokens emitted.
Which states may enter is told by the last bytes before the chunk: machines begun there and a little later soon agree, and
the states that they are in are the map's. (An entry state that is none of them is run when it comes up, so nothing
depends on the guess.) Where a piece starts in the chunk, all that follows is the same for every entry. Maps compose
associatively: a prefix scan over a text's chunks gives every prefix's. Long texts' chunks are dealt over tasks, each
makes its map by itself, and the maps, which are small, are composed for each text.
"""

from __future__ import annotations

import bisect
import functools
import struct
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, pretoken
from .bpe import Merges, merges
from .shared import importable, materialize

#: Compiled states, and bytes of counted words, that a worker keeps; beyond them it begins anew. A word needs so many
#: bytes besides its own.
STATES = 200_000
REMEMBERED, OVERHEAD = 48_000_000, 140
#: Characters in a chunk; of texts that are dealt over tasks, at least; and in a chunk of those.
CHUNK, SPLIT, DEALT = 16_384, 1_000_000, 131_072
#: Bytes before a chunk from which its entry states are told, and places there from which machines are begun.
BEFORE, BEGUN = 256, 4


class CountingTransducer:
    """Deterministic, over bytes; transitions carry emitted tokens."""

    def __init__(self, m: Merges, states: int = STATES):
        self.m, self.most = m, states
        self.token = {x: k for k, x in enumerate(m.bytes_of) if x and k != m.special_id}
        self.begins = {x[:k] for x in self.token for k in range(len(x))}
        # The parts that a token was made of, and when; bytes are older than all merges and have no parts.
        self.left, self.right, self.born = ([-1] * len(m.bytes_of) for _ in range(3))
        for (a, b), r in m.rank.items():
            self.left[m.made[r]], self.right[m.made[r]], self.born[m.made[r]] = a, b, r
        self.reset()

    def reset(self) -> None:
        start = (b"", struct.pack("<ii", -1, 0))
        self.number, self.state, self.go = {start: 0}, [start], {}

    def apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are when their bytes are merged together.

        They don't if, at some time of merging both, what then ends a and what then begins b is a pair that merges before
        either changes by itself. So the younger of the two is taken back to the parts it was made of, again and again.
        """
        pair, ends, begins, born = self.m.rank.get, self.right, self.left, self.born
        until = len(self.m.made)
        while a >= 0 and b >= 0:
            r = pair((a, b))
            if r is not None and r < until:
                return False
            # Before a's own merge b's seam must not change, and the other way round; of equal tokens, the left is first.
            if born[a] > born[b]:
                until, a = born[a], ends[a]
            else:
                until, b = born[b] + 1, begins[b]
        return True

    def places(self, suffix: bytes) -> tuple[int, ...]:
        """Where in the suffix a token that goes on beyond it can start."""
        return tuple(k for k in range(len(suffix) + 1) if suffix[k:] in self.begins)

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens emitted) for a transition not yet known."""
        suffix, packed = self.state[state]
        flat = struct.unpack(f"<{len(packed) // 4}i", packed)
        seen = [*zip(self.places(suffix), flat[::2], flat[1::2], strict=True)]
        grown = suffix + bytes((byte,))
        for k, a, n in seen:
            b = self.token.get(grown[k:])
            if b is not None and (a < 0 or self.apart(a, b)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        emitted = n + 1
        keep = [(k, t, c) for k, t, c in seen if grown[k:] in self.begins]
        cut = keep[0][0] if keep else len(grown)
        rest = [x for _, t, c in keep for x in (t, c - emitted)]
        new = (grown[cut:], struct.pack(f"<{len(rest) + 2}i", *rest, b, 0))
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.state)
            self.state.append(new)
        self.go[256 * state + byte] = to, emitted
        return to, emitted

    def run(self, word: bytes, state: int = 0) -> tuple[int, int]:
        """(state, tokens emitted) after the bytes of a piece, or of a part of it, from a state."""
        n, go = 0, self.go.get
        for b in word:
            state, k = go(256 * state + b) or self.compile(state, b)
            n += k
        return state, n

    def full(self) -> bool:
        return len(self.state) > self.most

    def key(self, state: int) -> bytes:
        """A state, for other machines."""
        suffix, packed = self.state[state]
        return struct.pack("<I", len(suffix)) + suffix + packed

    def of_key(self, key: bytes) -> int:
        n = 4 + struct.unpack("<I", key[:4])[0]
        new = (key[4:n], key[n:])
        if new not in self.number:
            self.number[new] = len(self.state)
            self.state.append(new)
        return self.number[new]

    def entries(self, before: bytes) -> set[int]:
        """The states in which a chunk may be entered behind these bytes of its piece."""
        return {self.run(before[k:])[0] for k in range(min(BEGUN, len(before)))} if before else {0}


class StateMap:
    """From entry states to (exit state, tokens)."""

    def __init__(self, to: dict[int, tuple[int, int]], run: Callable[[int], tuple[int, int]]):
        """run: gives what an entry state leads to that the map doesn't have yet."""
        self.to, self.run = to, run

    def __call__(self, entry: int) -> tuple[int, int]:
        if (got := self.to.get(entry)) is None:
            got = self.to[entry] = self.run(entry)
        return got

    def then(self, after: StateMap) -> StateMap:
        """The map of both chunks together."""

        def both(entry: int) -> tuple[int, int]:
            state, n = self(entry)
            last, more = after(state)
            return last, n + more

        return StateMap({entry: both(entry) for entry in self.to}, both)


def entered(fst: CountingTransducer, head: bytes, rest: tuple[int, int] | None) -> Callable[[int], tuple[int, int]]:
    """What an entry state leads to. head: the chunk's bytes before its first start of a piece; rest: the state and tokens
    of what follows, if any does."""

    def run(entry: int) -> tuple[int, int]:
        state, n = fst.run(head, entry)
        return (state, n) if rest is None else (rest[0], n + rest[1])

    return run


def chunk_map(fst: CountingTransducer, before: bytes, head: bytes, rest: tuple[int, int] | None) -> StateMap:
    run = entered(fst, head, rest)
    return StateMap({entry: run(entry) for entry in fst.entries(before)}, run)


def scan(maps: list[StateMap]) -> list[StateMap]:
    """All prefixes' compositions, in rounds over which the distance doubles; a round's compositions are independent."""
    step = 1
    while step < len(maps):
        maps = [m if k < step else maps[k - step].then(m) for k, m in enumerate(maps)]
        step *= 2
    return maps


class Chunk(NamedTuple):
    """Of a part's pieces: `before`, of the piece in which the chunk begins; `head`, up to the first start of a piece;
    whole pieces (from, to); and the `tail`, which begins the last one. tail is None if no piece starts."""

    before: str
    head: str
    whole: tuple[int, int]
    tail: str | None


def chunks(joined: str, at: list[int], lo: int, hi: int, size: int) -> Iterator[Chunk]:
    """Of the pieces lo to hi, each of `size` characters."""
    for a in range(at[lo], at[hi], size):
        b = min(a + size, at[hi])
        first, beyond = bisect.bisect_left(at, a, lo, hi), bisect.bisect_left(at, b, lo, hi)
        before = joined[max(at[first - 1], a - BEFORE) : a] if first > lo else ""
        if first == beyond:
            yield Chunk(before, joined[a:b], (first, first), None)
        else:
            yield Chunk(before, joined[a : at[first]], (first, beyond - 1), joined[at[beyond - 1] : b])


def count(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for each row of docs.

    n_tokens is as the tokenizers library has it for the vocabulary file at path, without tokens added at the ends; a
    special string in a text is one token, as by its default. Null counts as empty: no bytes, no tokens. Rows may repeat;
    other columns are ignored; an empty table gives no rows.
    """
    importable(docs.sparkSession)
    packed = pretoken.character_classes(path)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that aren't long are counted; the others' chunks, numbered within the text, are handed on."""
        fst, known = machine(path), {}
        special, size, numbers = fst.m.special, 0, blocks.block_ids()
        for batch in batches:
            keys, n = batch.column(0), len(batch)
            tokens, sizes, long, handed = [0] * n, [0] * n, [None] * n, []

            def texts(batch=batch, sizes=sizes, long=long):
                for k, x in enumerate(batch.column(1)):
                    text = x.as_py() or ""
                    sizes[k] = len(text.encode("utf-8", "surrogatepass"))
                    if len(text) > SPLIT:
                        long[k] = next(numbers)
                    yield k, text

            place = Counter()
            for group in pretoken.parts(texts(), special):
                joined, at, ranges = pretoken.split(group, packed)
                words = [*map(joined.__getitem__, map(slice, at, at[1:]))]
                if size > REMEMBERED:
                    known, size = {}, 0
                if fst.full():
                    fst.reset()
                for part, (lo, hi) in zip(group, ranges, strict=True):
                    tokens[part.row] += part.special
                    if lo == hi:
                        continue
                    if long[part.row] is not None:
                        for c in chunks(joined, at, lo, hi, DEALT):
                            cut = [len(w) for w in words[slice(*c.whole)]]
                            place[part.row] += 1
                            handed.append((part.row, place[part.row], c, "".join(words[slice(*c.whole)]), cut))
                        continue
                    for w in {*words[lo:hi]}:
                        if w in known:
                            continue
                        known[w] = fst.run(w.encode("utf-8", "surrogatepass"))[1] if len(w) <= CHUNK else None
                        size += len(w) + OVERHEAD
                    tokens[part.row] += _count_part(fst, known, joined, at, words, lo, hi)
            yield _rows(keys, sizes, tokens, long, handed)

    fields = f"id {kind}, n_bytes long, n_tokens long, text long, place int, before binary, head binary, whole string, cuts array<int>, tail binary"
    made = materialize(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(blocks.tidied(run), fields), "counts")
    out = made.where("place IS NULL").select("id", "n_bytes", "n_tokens", "text")
    apart = made.where("place IS NOT NULL")
    if not apart.isEmpty():
        maps = apart.repartition("text", "place").mapInArrow(blocks.tidied(_maps(path)), "text long, place int, head binary, entry array<binary>, exit array<binary>, emitted array<long>, rest binary, more long")
        whole = maps.groupBy("text").applyInArrow(_compose(path), "text long, more long")
        long = out.where("text IS NOT NULL").join(whole, "text").select("id", "n_bytes", (F.col("n_tokens") + F.col("more")).alias("n_tokens"), "text")
        out = out.where("text IS NULL").unionByName(long)
    n_tokens = F.col("n_tokens")
    return out.select(F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def _rows(ids: pa.Array, sizes: list[int], tokens: list[int], long: list, handed: list[tuple]) -> pa.RecordBatch:
    """A row for each text, and one for each chunk of a long one."""
    raw = lambda x: x.encode("utf-8", "surrogatepass")
    none = [None] * len(sizes)
    columns = {
        "id": pa.concat_arrays([ids, ids.take(pa.array([h[0] for h in handed], pa.int64()))]) if handed else ids,
        "n_bytes": pa.array(sizes + [None] * len(handed), pa.int64()), "n_tokens": pa.array(tokens + [None] * len(handed), pa.int64()),
        "text": pa.array(long + [long[h[0]] for h in handed], pa.int64()), "place": pa.array(none + [h[1] for h in handed], pa.int32()),
        "before": pa.array(none + [raw(h[2].before) for h in handed], pa.binary()), "head": pa.array(none + [raw(h[2].head) for h in handed], pa.binary()),
        "whole": pa.array(none + [h[3] for h in handed], pa.string()), "cuts": pa.array(none + [h[4] for h in handed], pa.list_(pa.int32())),
        "tail": pa.array(none + [None if h[2].tail is None else raw(h[2].tail) for h in handed], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _maps(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state map of each chunk: entries, where they lead and with how many tokens; and what follows any entry."""
        fst = machine(path)
        for batch in batches:
            for r in range(len(batch)):
                if fst.full():
                    fst.reset()
                x = {name: batch.column(name)[r].as_py() for name in ("text", "place", "before", "head", "whole", "cuts", "tail")}
                rest, lo, n = None, 0, 0
                if x["tail"] is not None:
                    counts = {}
                    for size in x["cuts"]:
                        w = x["whole"][lo : lo + size]
                        lo += size
                        if w not in counts:
                            counts[w] = fst.run(w.encode("utf-8", "surrogatepass"))[1]
                        n += counts[w]
                    state, more = fst.run(x["tail"])
                    rest = state, n + more
                to = chunk_map(fst, x["before"], x["head"], rest).to
                yield pa.RecordBatch.from_pydict({
                    "text": pa.array([x["text"]], pa.int64()), "place": pa.array([x["place"]], pa.int32()), "head": pa.array([x["head"]], pa.binary()),
                    "entry": pa.array([[fst.key(e) for e in to]], pa.list_(pa.binary())), "exit": pa.array([[fst.key(e) for e, _ in to.values()]], pa.list_(pa.binary())),
                    "emitted": pa.array([[k for _, k in to.values()]], pa.list_(pa.int64())),
                    "rest": pa.array([fst.key(rest[0]) if rest else None], pa.binary()), "more": pa.array([rest[1] if rest else None], pa.int64()),
                })

    return run


def _compose(path: str):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """The tokens of a text: the last of its chunks' prefix compositions, from the first state. A text has at most
        2^31 / DEALT chunks, as a value's size is limited."""
        fst, maps = machine(path), []
        for x in rows.sort_by("place").to_pylist():
            rest = (fst.of_key(x["rest"]), x["more"]) if x["rest"] is not None else None
            to = {fst.of_key(a): (fst.of_key(b), n) for a, b, n in zip(x["entry"], x["exit"], x["emitted"], strict=True)}
            maps.append(StateMap(to, entered(fst, x["head"], rest)))
        return pa.table({"text": pa.array([key[0].as_py()], pa.int64()), "more": pa.array([scan(maps)[-1](0)[1]], pa.int64())})

    return run


@functools.lru_cache(1)
def machine(path: str) -> CountingTransducer:
    return CountingTransducer(merges(path))


def _count_part(fst: CountingTransducer, known: dict[str, int | None], joined: str, at: list[int], words: list[str], lo: int, hi: int) -> int:
    """The tokens of the pieces lo to hi, by chunks of CHUNK characters."""
    if lo == hi:
        return 0
    if at[hi] - at[lo] <= CHUNK:
        return sum(map(known.__getitem__, words[lo:hi]))
    maps = []
    for c in chunks(joined, at, lo, hi, CHUNK):
        rest = None
        if c.tail is not None:
            state, n = fst.run(c.tail.encode("utf-8", "surrogatepass"))
            rest = state, n + sum(map(known.__getitem__, words[slice(*c.whole)]))
        maps.append(chunk_map(fst, c.before.encode("utf-8", "surrogatepass"), c.head.encode("utf-8", "surrogatepass"), rest))
    return scan(maps)[-1](0)[1]
