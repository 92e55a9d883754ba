"""Importance resampling against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallygrid.llm import resample, shared

from . import brute

WORDS = "abcdefgh é ß xy 12 Word".split()


@pytest.fixture(scope="module", autouse=True)
def reachable(spark):
    shared.importable(spark)


def features(text, run):
    w = brute.WORD.findall(brute.fold(text))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, run + 1) for i in range(len(w) - n + 1)]


def bucket(x, buckets):
    return zlib.crc32(x.encode()) % buckets


def plain(rows, target, buckets=10_000, run=2, share=25, least=20, seed=7):
    s, t = (Counter(bucket(x, buckets) for text in texts for x in features(text, run)[1]) for texts in ([x for _, x in rows], target))
    gain = [math.floor(1000 * math.log((t[k] + 1.0) * (s.total() + buckets) / ((s[k] + 1.0) * (t.total() + buckets)))) for k in range(buckets)]
    out = []
    for i, text in rows:
        n, own = features(text, run)
        weight = sum(gain[bucket(x, buckets)] for x in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    able = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: share * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


ROWS = brute.texts(5) + [(3, "again " * 25), (3, "again " * 25), (3, "again " * 25)]
TARGET = [x for _, x in ROWS[:7]] + [None, "", "Word xy"]


@pytest.mark.parametrize("how", [{}, {"run": 3, "buckets": 97, "share": 60, "least": 1}, {"run": 1, "share": 100, "least": 0, "seed": 9}])
def test_ranks(spark, how):
    found = resample.resample(brute.frame(spark, ROWS), brute.frame(spark, [(k, x) for k, x in enumerate(TARGET)]), **{k.replace("least", "least_words"): v for k, v in how.items()})
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(ROWS, TARGET, **how)


def test_drawn_rows_have_all_columns(spark):
    docs = brute.frame(spark, ROWS)
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    for share in (25, 100):
        want = sorted(((x[0], x[3]) for x in plain(ROWS, TARGET, share=share, least=1) if x[4]), key=repr)
        found = resample.draw(docs, target, share=share, least_words=1)
        assert found.columns == docs.columns
        text = {i: t for i, t in ROWS}
        assert sorted((r["doc_id"] for r in found.collect()), key=repr) == sorted((i for i, _ in want), key=repr)
        assert all(r["text"] == text[r["doc_id"]] for r in found.collect() if r["doc_id"] not in (None, 3, 5, 7))
    assert resample.draw(docs, target, share=0).count() == 0 == resample.draw(docs.limit(0), target).count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    found = resample.resample(brute.frame(spark, ROWS), none)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(ROWS, [])


def test_long_texts_and_full_tries(monkeypatch):
    """Pieces of texts and new tries change nothing."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(n)).encode() for n in (3_000, 0, 1, 2, 40_000)] + [None, b"x" * 5_000, b"..."]
    want = [Counter(bucket(x.decode(), 1_000) if isinstance(x, bytes) else bucket(x, 1_000) for x in features((t or b"").decode(), 3)[1]) for t in texts]
    monkeypatch.setattr(resample, "PIECE", 700)
    monkeypatch.setattr(resample, "NODES", 900)
    trie = resample.Trie(1_000, 3)
    words, _ = resample._walked(trie, texts)
    assert words.tolist() == [features((t or b"").decode(), 3)[0] for t in texts]
    assert trie.fold().tolist() == [sum(c[k] for c in want) for k in range(1_000)]
    gain = np.random.default_rng(1).integers(-500, 500, 1_000)
    _, sums = resample._walked(resample.Trie(1_000, 3, gain), texts)
    assert sums.tolist() == [sum(int(gain[k]) * n for k, n in c.items()) for c in want]
