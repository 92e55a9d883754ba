"""Vector codes against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallygrid.llm import codes, shared

from . import brute


@pytest.fixture(scope="module", autouse=True)
def reachable(spark):
    shared.importable(spark)


def plain(rows, parts, entries, rounds, scale, size):
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))
    w = size // parts
    cut = lambda q, p: q[p * w : (p + 1) * w]
    books = [[cut(q, p) for _, _, q in kept[:entries]] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, _, q in kept:
                of.setdefault(best(cut(q, p), books[p])[1], []).append(cut(q, p))
            books[p] = [[sum(c) // len(c) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])]
    out, by = [], {}
    for i, lab, q in kept:
        found = [best(cut(q, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), lab))
        by[lab] = by.get(lab, 0) + out[-1][2]
    h = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[lab], h) for i, c, e, lab in out), key=repr)


def vectors(n, size, seed=1):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(7)]
    rows = [(k, [x + rng.gauss(0, 0.2) for x in middles[rng.randrange(7)]], rng.choice([0, 1, 2, None])) for k in range(n)]
    bad = [(n, None, 1), (n + 1, [math.nan] + [0.0] * (size - 1), 1), (-1, [math.inf] * size, 1), (-2, [None] * size, 0), (n + 2, [1.0] * (size + 1), 0), (n + 3, [], 0)]
    same = [(k, [0.5] * size, 5) for k in range(n + 10, n + 40)] + [(2, rows[2][1], None), (2, rows[3][1], 1), (None, rows[5][1], 0), (None, rows[5][1], 0)]
    return rows + bad + same


@pytest.mark.parametrize("n, parts, entries, rounds, size", [(150, 8, 16, 6, 64), (40, 2, 5, 2, 6), (9, 3, 16, 3, 3), (30, 1, 4, 0, 10)])
def test_codes(spark, n, parts, entries, rounds, size):
    rows = vectors(n, size)
    found = codes.compress(brute.frame(spark, rows, "vec_id long, embedding array<double>, label int"), parts=parts, entries=entries, rounds=rounds)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, parts, entries, rounds, 4096, size)


def test_tables_without_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [math.nan, 1.0], None)]):
        assert codes.compress(brute.frame(spark, rows, "vec_id long, embedding array<float>, label int")).count() == 0
    with pytest.raises(ValueError):
        codes.compress(brute.frame(spark, [(1, [1.0] * 12, 0)], "vec_id long, embedding array<float>, label int"))
    with pytest.raises(Exception, match="must lie between"):
        codes.compress(brute.frame(spark, [(1, [1e9] * 8, 0)], "vec_id long, embedding array<float>, label int")).collect()


def test_the_nearest_entry(spark):
    """Bounds leave out no entry that is nearest, and many that are not."""
    rng = np.random.default_rng(3)
    for width, spread in ((1, 5), (2, 3), (6, 2), (8, 4_096), (8, 1 << 23), (16, 300), (64, 1_000)):
        entries = rng.integers(-spread, spread, (16, width))
        x = np.concatenate([entries[rng.integers(0, 16, 500)] + rng.integers(-spread // 8 - 1, spread // 8 + 2, (500, width)), rng.integers(-spread, spread, (300, width)), np.full((20, width), spread - 1)])
        want = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        k, d, seen = codes.nearest(x, entries)
        assert (k == want.argmin(1)).all() and (d == want.min(1)).all()
        assert width < 8 or seen < len(x) * 9  # of 17
    assert len(codes.nearest(np.zeros((0, 8), np.int64), entries[:, :8])[0]) == 0


def test_decoded_vectors_are_near(spark):
    rows = [(k, v, 0) for k, v, _ in vectors(60, 16)[:60]]
    packed = codes.vectors(brute.frame(spark, rows, "vec_id long, embedding array<double>, label int").select("vec_id", "embedding", "label"))
    books = codes.fit(packed, parts=4, entries=8, rounds=3)
    found = codes.decode(codes.encode(packed, books), books).collect()
    own = {k: v for k, v, _ in rows}
    for r in found:
        apart = sum((math.floor(4096 * a) - 4096 * b) ** 2 for a, b in zip(own[r["vec_id"]], r["vector"], strict=True))
        assert apart == r["error"]
