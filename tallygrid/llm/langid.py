"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, which a forward pass gives; a text's is the product over its words. The piece probabilities
are learnt by expectation maximisation over the same lattices. Words are compared in lower case, with the vocabulary's
mark for a word's start. Long words, such as whole sentences of a script without blanks, are walked in logarithms, with
no more of the forward vectors at hand than the longest piece needs.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import tidied
from .shared import broadcast_if_small, importable

#: Training documents of each language, about; EM rounds; what is added to each piece's expected count.
SAMPLE_DOCS = 500
ROUNDS = 4
ADDED = 0.01
#: Letters of a word whose probability is safe from underflow; longer words are walked in logarithms.
WORD = 24
#: Longer words are walked together while their number times the longest one's letters is at most this.
CELLS = 400_000
#: Bytes of words, with their log probabilities, that a worker keeps, about; beyond them it begins anew.
REMEMBERED = 64_000_000
#: What Python needs for a word, besides its letters and probabilities; words of short ones walked at once; characters
#: of texts judged at once.
OVERHEAD, WALKED, JUDGED = 150, 5_000, 1_000_000
UNKNOWN = "und"

_WORDS = re.compile(r"[^\W\d_]+")
_START = "▁"


@functools.lru_cache(2)
def pieces(path: str) -> dict[str, int]:
    """The vocabulary's pieces of letters, as they are in lower case, numbered from 1; 0 is any other character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    own = {p for p in found if p == p.lower() and (p == _START or all(map(str.isalpha, p.removeprefix(_START))))}
    return with_beginnings(sorted(own))


def with_beginnings(own: list[str]) -> dict[str, int]:
    """The pieces by number, and what else begins one with -1."""
    return {p[:k]: -1 for p in own for k in range(1, len(p))} | {p: k for k, p in enumerate(own, 1)}


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, however long."""
    return _WORDS.findall(text.lower())


class Lattice:
    """The arcs of all segmentations of some words: word, start, end and piece of each."""

    def __init__(self, words: list[str], vocab: dict[str, int]):
        """vocab: pieces, and their beginnings with -1."""
        self.size = np.array([len(w) + 1 for w in words], np.int64)
        found: list[int] = []
        get = vocab.get
        for n, w in enumerate(words):
            w = _START + w
            last = len(w)
            for start in range(last):
                one = get(w[start])
                if one is None or one < 0:  # no piece by itself: an unknown character
                    found += (n, start, start + 1, 0)
                    if one is None:
                        continue
                for end in range(start + 1, last + 1):
                    k = get(w[start:end])
                    if k is None:
                        break
                    if k > 0:
                        found += (n, start, end, k)
        self.word, self.start, self.end, self.piece = np.array(found, np.int32).reshape(-1, 4).T.astype(np.int64)
        self.places = max([*self.size.tolist(), 1]) + 1

    def _pass(self, a: np.ndarray, p: np.ndarray, here: np.ndarray, there: np.ndarray, places: range) -> None:
        """Fill a (words, places, languages) place by place with sums over arcs from there to here."""
        order = np.argsort(here, kind="stable")
        cuts = np.searchsorted(here[order], np.arange(self.places + 1))
        for x in places:
            arcs = order[cuts[x] : cuts[x + 1]]
            w = self.word[arcs]
            flow = a[w, there[arcs]] * p[self.piece[arcs]]
            for k in range(p.shape[1]):
                a[:, x, k] += np.bincount(w, flow[:, k], len(self.size))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(words, places, languages): the probability of each prefix."""
        a = np.zeros((len(self.size), self.places, p.shape[1]))
        a[:, 0] = 1
        self._pass(a, p, self.end, self.start, range(1, self.places))
        return a

    def total(self, p: np.ndarray) -> np.ndarray:
        """(words, languages): the probability of each word."""
        return self.forward(p)[np.arange(len(self.size)), self.size]

    def expected(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(pieces, languages): how often each piece is expected in words that occur n (words, languages) times."""
        a, at = self.forward(p), np.arange(len(self.size))
        b = np.zeros_like(a)
        b[at, self.size] = n / np.maximum(a[at, self.size], 1e-300)
        self._pass(b, p, self.start, self.end, range(self.places - 1, -1, -1))
        flow = a[self.word, self.start] * p[self.piece] * b[self.word, self.end]
        return np.stack([np.bincount(self.piece, flow[:, k], len(p)) for k in range(p.shape[1])], 1)


class Runs:
    """The segmentations of long words, walked place by place in all of them at once; arcs are found on the way."""

    def __init__(self, words: list[str], vocab: dict[str, int]):
        self.words, self.vocab = [_START + w for w in words], vocab
        self.size = np.array([*map(len, self.words)], np.int64)
        self.order = np.argsort(self.size, kind="stable")
        self.sorted = self.size[self.order]
        self.places = int(self.sorted[-1])
        self.longest = max(map(len, vocab), default=1)

    def arcs(self, start: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, words, pieces) of the pieces that begin at this place, no word twice at a length."""
        found: dict[int, tuple[list[int], list[int]]] = {}
        get = self.vocab.get
        for n in self.order[np.searchsorted(self.sorted, start, "right") :].tolist():
            w = self.words[n]
            for end in range(start + 1, min(start + self.longest, len(w)) + 1):
                k = get(w[start:end])
                if end == start + 1 and (k is None or k < 0):  # no piece by itself: an unknown character
                    at = found.setdefault(1, ([], []))
                    at[0].append(n)
                    at[1].append(0)
                if k is None:
                    break
                if k > 0:
                    at = found.setdefault(end - start, ([], []))
                    at[0].append(n)
                    at[1].append(k)
        return [(d, np.array(w), np.array(k)) for d, (w, k) in sorted(found.items())]

    def _forward(self, logs: np.ndarray, kept: list[np.ndarray] | None = None) -> np.ndarray:
        """(words, languages): log probabilities; the (words, languages) prefixes of each place are added to kept."""
        out = np.zeros((len(self.words), logs.shape[1]))
        ahead = [np.full_like(out, -np.inf) for _ in range(self.longest + 1)]
        ahead[0][:] = 0
        for start in range(self.places + 1):
            now = ahead[start % len(ahead)]
            ends = self.order[slice(*np.searchsorted(self.sorted, [start, start + 1]))]
            out[ends] = now[ends]
            if kept is not None:
                kept.append(now.copy())
            for d, w, k in self.arcs(start):
                there = ahead[(start + d) % len(ahead)]
                there[w] = np.logaddexp(there[w], now[w] + logs[k])
            now[:] = -np.inf
        return out

    def log_total(self, p: np.ndarray) -> np.ndarray:
        """(words, languages): the log probability of each word."""
        return self._forward(np.log(np.maximum(p, 1e-300)))

    def expected(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(pieces, languages): how often each piece is expected in words that occur n (words, languages) times."""
        logs, kept, out = np.log(np.maximum(p, 1e-300)), [], np.zeros_like(p)
        total = self._forward(logs, kept)
        behind = [np.full_like(total, -np.inf) for _ in range(self.longest + 1)]
        for start in range(self.places, -1, -1):
            now = behind[start % len(behind)]
            now[:] = -np.inf
            now[self.order[slice(*np.searchsorted(self.sorted, [start, start + 1]))]] = 0
            for d, w, k in self.arcs(start):
                flow = logs[k] + behind[(start + d) % len(behind)][w]
                now[w] = np.logaddexp(now[w], flow)
                np.add.at(out, k, np.exp(kept[start][w] + flow - total[w]) * n[w])
        return out


def parted(words: list[str]) -> tuple[list[int], list[list[int]]]:
    """The places of the short words, and those of the long ones in groups that are walked together."""
    long = sorted((k for k, w in enumerate(words) if len(w) > WORD), key=lambda k: len(words[k]))
    groups: list[list[int]] = []
    for k in long:
        if not groups or (len(groups[-1]) + 1) * len(words[k]) > CELLS:
            groups.append([])
        groups[-1].append(k)
    return [k for k, w in enumerate(words) if len(w) <= WORD], groups


def learn(counts: list[tuple[str, str, int]], vocab: dict[str, int], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities) from (language, word, times)."""
    languages = sorted({lang for lang, _, _ in counts})
    of = {x: k for k, x in enumerate(languages)}
    place = {w: k for k, w in enumerate(sorted({w for _, w, _ in counts}))}
    n = np.zeros((len(place), len(languages)))
    for lang, w, k in counts:
        n[place[w], of[lang]] += k
    n_pieces = max(vocab.values(), default=0) + 1
    p = np.full((n_pieces, len(languages)), 1 / n_pieces)
    words = list(place)
    short, groups = parted(words)
    parts = [(Lattice([words[k] for k in at], vocab), n[at]) for at in (short[k : k + 20_000] for k in range(0, len(short), 20_000))]
    parts += [(Runs([words[k] for k in at], vocab), n[at]) for at in groups]
    for _ in range(rounds):
        got = sum((part.expected(p, m) for part, m in parts), np.zeros_like(p)) + ADDED
        p = got / got.sum(0)
    return languages, p


def held_out(doc_id, folds: int = 5) -> bool:
    """Whether a document is kept from training: crc32 of its id as text is 0 modulo folds. Null is."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


def training_words(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """(lang, word, n) over about `sample` documents of each language, chosen by a hash of their ids."""
    at = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    at = at.where((F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = at.groupBy("lang").agg((sample / F.count("*")).alias("share"))
    drawn = (F.xxhash64("id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    at = at.withColumn("drawn", drawn).join(broadcast_if_small(share, 10_000), "lang").where("drawn < share").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
            langs, words = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array([*found.values()], pa.int64())], ["lang", "word", "n"])

    return at.mapInArrow(tidied(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Scorer:
    def __init__(self, languages: list[str], p: np.ndarray, vocab: dict[str, int]):
        self.languages, self.p, self.vocab = languages, p, vocab
        self.place: dict[str, int] = {}
        self.size = 0
        self.logs = np.zeros((0, len(languages)))

    def learn(self, words: set[str]) -> None:
        if self.size > REMEMBERED:
            self.place, self.logs, self.size = {}, self.logs[:0].copy(), 0
        new = [w for w in words if w not in self.place]
        self.size += sum(map(len, new)) + len(new) * (OVERHEAD + 8 * len(self.languages))
        short, groups = parted(new)
        logs = [self.logs]
        for k in range(0, len(short), WALKED):
            logs.append(np.log(np.maximum(Lattice([new[x] for x in short[k : k + WALKED]], self.vocab).total(self.p), 1e-300)))
        for at in groups:
            logs.append(Runs([new[x] for x in at], self.vocab).log_total(self.p))
        new = [new[x] for at in (short, *groups) for x in at]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.logs = np.concatenate(logs)

    def judge_all(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        preds, scores, lo = [], [], 0
        while lo < len(texts):
            found, letters, size = [], [], 0  # words of each text
            while lo < len(texts) and size < JUDGED:
                x = texts[lo].as_py() or ""
                size += len(x)
                found.append(words := words_of(x))
                letters.append(any(w.isalpha() for w in words) or any(map(str.isalpha, x)))
                lo += 1
            self.learn({w for words in found for w in words})
            for words, has in zip(found, letters, strict=True):
                pred, score = self.judge(words, has)
                preds.append(pred)
                scores.append(score)
        return preds, scores

    def judge(self, words: list[str], has_letter: bool) -> tuple[str, float]:
        if not words or not has_letter or not self.languages:
            return UNKNOWN, 0.0
        x = self.logs[[*map(self.place.__getitem__, words)]].sum(0)
        k = int(x.argmax())
        return self.languages[k], float(1 / np.exp(x - x[k]).sum())


def predict(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> DataFrame:
    """(id_col, held_out, lang_pred, score) for each row of docs.

    Probabilities are learnt from about `sample` documents of each language, of those whose crc32 of the id as text isn't
    0 modulo 5 and whose language isn't null; a null id is held out. lang_pred is the language with the greatest
    probability of the whole text (ties: the first by name), score its share among all languages. Null, empty and
    letterless texts, and all if there is nothing to learn from, have lang_pred und and score 0. Rows may repeat; other
    columns are ignored; an empty table gives no rows.
    """
    importable(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    languages, p = fit(docs, path, id_col, text_col, lang_col, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(languages, p, pieces(path))
        for batch in batches:
            ids = batch.column(0)
            preds, scores = scorer.judge_all(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([held_out(x) for x in ids.to_pylist()]), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [id_col, "held_out", "lang_pred", "score"]
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidied(run), f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def fit(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities) of the training documents."""
    counts = training_words(docs, id_col, text_col, lang_col, sample).toArrow()
    return learn(sorted(zip(*(counts.column(k).to_pylist() for k in range(3)), strict=True)), pieces(path))


def accept(docs: DataFrame, path: str, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language, with at least this score."""
    importable(docs.sparkSession)
    languages, p = fit(docs, path, id_col, text_col, lang_col, sample)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(languages, p, pieces(path))
        for batch in batches:
            preds, scores = scorer.judge_all(batch.column(place))
            yield batch.filter(pa.array([lang != UNKNOWN and x >= least for lang, x in zip(preds, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
