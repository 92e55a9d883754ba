"""Plain Python versions of the operators, and documents that are awkward on purpose."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

#: Names that operators use inside.
CLASHING = ["id", "text_key", "th", "h", "at", "block", "ids", "ref", "digest", "keep_id", "component", "node", "word", "n", "own", "batch", "__gone", "conv", "seq", "url_", "address", "k"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def fold(text):
    return (text or "").translate(AZ)


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    """rows, with columns that clash with names inside the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHING if c not in df.columns}).repartition(parts)


def texts(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [say(rng.randint(1, 120)) for _ in range(40)]
    out = list(base)
    for x in base[:15]:  # near copies, of one to three words changed
        for _ in range(3):
            w = x.split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    shared = say(60)
    out += [f"{say(5)} {shared} {say(4)}" for _ in range(6)]
    out += [base[0].upper(), base[0].upper(), base[0], "", None, "", "...", "a b c", "A b C", "a b c d", "é", "É", "x" * 3000, "it's 'll  we're\t\n  don't<|endoftext|>", say(9000), "1 2 3 4 5 6"]
    rows = list(enumerate(out))
    return rows + [(None, base[3]), (None, None), (5, out[5]), (7, "another text with the id seven")]


def windows(words, size=10):
    n = min(size, len(words))
    return [(tuple(words[i : i + n])) for i in range(len(words) - n + 1)] if words else []


def decontaminate(rows, items):
    out = []
    of = defaultdict(set)
    for i, t in items:
        for w in windows(WORD.findall(fold(t))):
            of[w].add(i)
    for i, t in rows:
        words, hit, found = WORD.findall(fold(t)), set(), set()
        for n in {len(w) for w in of}:
            for a in range(len(words) - n + 1):
                if (w := tuple(words[a : a + n])) in of:
                    hit |= {*range(a, a + n)}
                    found |= {str(x) for x in of[w] if x is not None}
        out.append((i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def repeats(rows, length):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = WORD.findall(fold(text))
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


class Sets(dict):
    """Disjoint sets with their least member."""

    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def near(rows, similarity=0.8):
    """(id, class, size, links, shingles) by comparing all pairs; ids must be distinct."""
    sets = {i: shingles(t) for i, t in rows}
    groups, links, distinct = Sets(), Counter(), defaultdict(list)
    for i, s in sets.items():
        groups.root(i)
        if s:
            distinct[s].append(i)
    for ids in distinct.values():
        for i in ids:
            groups.join(i, ids[0])
    for a in distinct:
        for b in distinct:
            if a is not b and len(a & b) >= similarity * len(a | b) - 1e-9:
                links[a] += 1
                groups.join(distinct[a][0], distinct[b][0])
    size = Counter(groups.root(i) for i in sets)
    return [(i, groups.root(i), size[groups.root(i)], links[s], len(s)) for i, s in sets.items()]


def factors(counts):
    """Good-Turing's factors for counts 1 to 5 after Katz; absolute discounting's where they aren't between 0 and 1."""
    n = Counter(counts)
    share = 6 * n[6] / n[1] if n[1] else 1
    less = min(max(n[1] / (n[1] + 2 * n[2]), 0.1), 0.9) if n[1] + n[2] and n[1] else 0.5
    out = {}
    for r in range(1, 6):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if n[r] and share < 1 else -1
        out[r] = x if 0 < x < 1 else (r - less) / r
    return out


class Katz:
    def __init__(self, texts, order):
        """texts: lists of tokens."""
        self.order, self.follow = order, defaultdict(Counter)
        for w in texts:
            seq = ["<begin>", *w]
            for i in range(1, len(seq)):
                for n in range(order):
                    if i - n >= 0:
                        self.follow[tuple(seq[i - n : i])][seq[i]] += 1
        self.one = self.follow[()]
        by = defaultdict(list)
        for context, f in self.follow.items():
            by[len(context)] += f.values()
        self.d = {n: factors(c) for n, c in by.items()}

    def left(self, context):
        f = self.follow[context]
        n, d = sum(f.values()), self.d[len(context)]
        if not n:
            return 1
        return sum((1 - d[c]) * c for c in f.values() if c <= 5) / n if min(f.values()) <= 5 else 1 / (n + 1)

    def own(self, context, w):
        f, d = self.follow[context], self.d[len(context)]
        n = sum(f.values())
        return d.get(f[w], 1) * f[w] / n if min(f.values()) <= 5 else f[w] / (n + 1)

    def weight(self, context):
        return self.left(context) / (1 - sum(self.p(context[1:], w) for w in self.follow[context]))

    def p(self, context, w):
        f = self.follow.get(context)
        if not context:
            return self.own(context, w) if f and w in f else self.left(context)
        if not f:
            return self.p(context[1:], w)
        return self.own(context, w) if w in f else self.weight(context) * self.p(context[1:], w)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text)) + [None]


def katz_scores(rows, order=2, learn=None):
    """Scores of rows by a model of `learn`, or of rows themselves."""
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    model = Katz([words_of(t) for i, t in (rows if learn is None else learn) if not held(i)], order)
    one, total = model.one, sum(model.one.values())
    out = []
    for i, t in rows:
        w = words_of(t)
        seq = ["<begin>", *w]
        base = sum(math.log10((one[x] + 0.1) / (total + 0.1 * (len(one) + 1))) for x in w)
        full = sum(math.log10(model.p(tuple(seq[max(0, k - order + 1) : k]), seq[k])) for k in range(1, len(seq)))
        out.append((i, held(i), len(w), sum(one[x] > 0 for x in w), total, base, full))
    return out, model


def segmentations(word, pieces):
    """All ways to cut a word into pieces, as lists of numbers; a character that is no piece by itself is 0."""
    if not word:
        return [[]]
    out = []
    for k in range(1, len(word) + 1):
        number = pieces.get(word[:k], 0 if k == 1 else -1)
        if number < 0 and k == 1:
            number = 0
        if number >= 0:
            out += [[number, *rest] for rest in segmentations(word[k:], pieces)]
    return out


def language(rows, pieces, rounds, added):
    """(id, language, share) of (id, text, lang) rows: every sum over segmentations is written out. No row may be left
    out of the sample."""
    split = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    counts = defaultdict(Counter)
    for i, t, lang in rows:
        if not held(i) and lang is not None and t is not None:
            counts[lang].update(split(t))
    ways = {w: segmentations("\u2581" + w, pieces) for i, t, _ in rows for w in split(t or "")}
    size = max(pieces.values()) + 1
    p = {lang: [1 / size] * size for lang in counts}
    for _ in range(rounds):
        for lang, words in counts.items():
            got = [added] * size
            for w, n in words.items():
                each = [(math.prod(p[lang][k] for k in way), way) for way in ways[w]]
                whole = sum(x for x, _ in each)
                for x, way in each:
                    for k in way:
                        got[k] += n * x / whole
            p[lang] = [x / sum(got) for x in got]
    out = []
    for i, t, _ in rows:
        words = split(t or "")
        logs = {lang: sum(math.log(sum(math.prod(q[k] for k in way) for way in ways[w])) for w in words) for lang, q in p.items()}
        best = max(sorted(logs), key=logs.get)
        out.append((i, best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())) if words else (i, "und", 0.0))
    return out
