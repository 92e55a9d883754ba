"""Pre-tokenization of byte-level BPE vocabularies: the pieces of a text that merges never cross.

The rule is that of the published pattern (contractions, letter, digit and other runs with one blank before them, white
space that leaves its last character to what follows). Whether a piece starts at a character depends on few characters
around it, so the starts of a whole batch of texts come from a handful of array operations. Which characters are
letters, digits or white space is asked of the tokenizer library itself, whose Unicode tables are those that count.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

OTHER, LETTER, DIGIT, SPACE, EDGE = range(5)
#: Characters of a batch of texts that is split at once.
BATCH_CHARS = 1_000_000


@functools.lru_cache(4)
def character_classes(path: str) -> bytes:
    """The class of every code point under the vocabulary at path, one byte each, compressed."""
    from tokenizers import Tokenizer

    pre = Tokenizer.from_file(path).pre_tokenizer
    out = np.full(0x110000, SPACE, np.uint8)
    todo = np.array_split(np.r_[0:0xD800, 0xE000:0x110000], 1024)
    while todo:
        part = todo.pop()
        chars = "".join(map(chr, part))
        for kind, mate in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!"), (SPACE, "\n")):
            # Characters of the kind of `mate` stay in one piece with it; most runs of code points are of one kind.
            if len(pre.pre_tokenize_str(mate + chars)) == 1:
                out[part] = kind
                break
        else:
            todo += np.array_split(part, min(len(part), 16))
    return zlib.compress(out.tobytes())


@functools.lru_cache(4)
def _table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def starts(codes: np.ndarray, edges: np.ndarray, packed: bytes) -> np.ndarray:
    """Where pieces start. codes: code points of texts joined by one character each, which stand at `edges`."""
    if not len(codes):
        return np.zeros(0, np.int64)
    kind = _table(packed)[codes]
    kind[edges] = EDGE
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0], before[1:] = EDGE, kind[:-1]
    after[-1], after[:-1] = EDGE, kind[1:]
    space = kind == SPACE
    was_space = before == SPACE
    start = kind != before
    start[0] = True
    start |= kind == EDGE
    start |= before == EDGE
    # Of two or more white space characters, the last is left to what follows.
    start |= space & was_space & (after != SPACE) & (after != EDGE)
    # One blank goes with what follows it.
    follows = np.flatnonzero(was_space & ~space & (kind != EDGE))
    start[follows] = codes[follows - 1] != 32
    for at, n in contractions(codes, before, kind):
        start[at] = True
        start[at + 1] = False
        end = at + n
        end = end[end < len(codes)]
        start[end] = True
    return np.flatnonzero(start)


def contractions(codes: np.ndarray, before: np.ndarray, kind: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Where pieces of two and of three characters such as 's and 're are."""
    at = np.flatnonzero((codes == 39) & (kind != EDGE))
    at = at[(before[at] != OTHER)]
    prev = codes[np.maximum(at - 1, 0)]
    at = at[~((before[at] == SPACE) & (prev == 32)) & (at + 1 < len(codes))]
    one = codes[at + 1]
    own = kind[at + 1] != EDGE
    two = np.isin(one, [ord(c) for c in "stmd"]) & own
    rest = at[~two & own & (at + 2 < len(codes))]
    a, b = codes[rest + 1], codes[rest + 2]
    three = (kind[rest + 2] != EDGE) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
    return [(at[two], 2), (rest[three], 3)]


def cut(text: str, limit: int) -> Iterator[str]:
    """The text in parts of about `limit` characters, cut only before a blank after a letter, where a piece always starts."""
    lo = 0
    while len(text) - lo > limit:
        at = text.rfind(" ", lo + 1, lo + limit)
        while at > lo and not text[at - 1].isalpha():
            at = text.rfind(" ", lo + 1, at)
        if at <= lo:
            at = next((k for k in range(lo + limit, len(text)) if text[k] == " " and text[k - 1].isalpha()), len(text))
        yield text[lo:at]
        lo = at
    yield text[lo:]


class Part:
    """A part of a text: which text, whether a special token stands before it, and whether it is the text's last."""

    __slots__ = ("row", "special", "last", "text")

    def __init__(self, row, special: bool, last: bool, text: str):
        self.row, self.special, self.last, self.text = row, special, last, text


def parts(rows: Iterable[tuple[object, str]], special: str, limit: int = BATCH_CHARS) -> Iterator[list[Part]]:
    """(row, text) as lists of parts of about `limit` characters together; `special` splits texts and is left out."""
    out, size = [], 0
    for row, text in rows:
        between = text.split(special) if special else [text]
        for k, x in enumerate(between):
            pieces = list(cut(x, limit))
            for j, y in enumerate(pieces):
                out.append(Part(row, k > 0 and j == 0, k == len(between) - 1 and j == len(pieces) - 1, y))
                size += len(y) + 1
                if size >= limit:
                    yield out
                    out, size = [], 0
    if out:
        yield out


def split(batch: list[Part], packed: bytes) -> tuple[str, list[int], list[tuple[int, int]]]:
    """The joined text, where its pieces start (and its end), and for each part the range of its pieces."""
    joined = "\x00".join(p.text for p in batch)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter((len(p.text) + 1 for p in batch), np.int64, len(batch))
    edges = np.cumsum(sizes) - 1
    at = starts(codes, edges[:-1], packed)
    hi = np.searchsorted(at, edges)
    lo = np.searchsorted(at, np.r_[0, edges[:-1] + 1])
    return joined, [*at.tolist(), len(joined)], list(zip(lo.tolist(), hi.tolist(), strict=True))
