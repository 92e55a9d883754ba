"""What a block of texts, and a batch of blocks, take at once."""

import numpy as np

from tallygrid.llm import blocks, repeats


def test_surroundings_are_spelt_out_in_parts(monkeypatch):
    """Of a block with a hot string at each byte, all 400 bytes of each were there at once."""
    text = b"ab" * 3_000 + bytes(range(65, 91)) * 20
    raw, ends = np.frombuffer(text, np.uint8), np.array([4_000, len(text)])
    _, own, _ = repeats._own_anchors(raw, ends, 50)
    a = repeats.strings_of(raw, ends, np.unique(own), 50)
    want = repeats._distinct(raw, ends, a, 50)
    plain = repeats.surroundings(raw, ends, a.places, a.sizes, 50)
    asked, real = [], repeats.surroundings
    monkeypatch.setattr(repeats, "surroundings", lambda raw, ends, at, *x: asked.append(len(at)) or real(raw, ends, at, *x))
    monkeypatch.setattr(repeats, "AT_ONCE", 100)
    first, times, where, rows = repeats._distinct(raw, ends, a, 50)
    assert max(asked) == 100 and sum(asked) == len(a.places) > 5_000 and times.sum() == len(a.places) > 10 * len(times)
    assert (rows[where] == plain).all() and (np.diff(a.hashes[first].astype(float)) >= 0).all()
    assert all((x == y).all() for x, y in zip((first, times, where, rows), want, strict=True))


def test_batches_are_bounded_but_never_more_loosely(spark):
    key, rows = blocks.BATCHES
    try:
        spark.conf.unset(key)
        spark.conf.set(rows, "32")
        blocks.bounded(spark)
        assert (spark.conf.get(key), spark.conf.get(rows)) == ("8m", "32")
        for now, want in (("4194304", "4194304"), ("1g", "8m"), ("512k", "512k")):
            spark.conf.set(key, now)
            blocks.bounded(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.unset(key)
        spark.conf.unset(rows)


def test_strings_are_looked_for_around_their_anchors_only(monkeypatch):
    """A block with one hot anchor was hashed as a whole once more."""
    rng = np.random.default_rng(3)
    raw, ends, length = rng.integers(97, 123, 60_000).astype(np.uint8), np.array([10, 20_000, 20_000, 20_100, 45_000, 60_000]), 200
    start, own, _ = repeats._own_anchors(raw, ends, length)
    seen, real = [], repeats.gram_hashes
    monkeypatch.setattr(repeats, "gram_hashes", lambda raw, size: seen.append(len(raw)) or real(raw, size))
    for hot in (own[[0]], own[[-1]], np.unique(own[[100, 101, 500, 19_000, 25_000]]), np.zeros(0, np.int64)):
        seen.clear()
        a = repeats.strings_of(raw, ends, hot, length)
        assert sum(seen) <= 2 * 2 * length * len(hot)
        want = start[np.isin(own, hot)]
        assert (a.places == want).all() and (a.bases == own[np.isin(own, hot)] - want).all() and (a.sizes == length).all()
        assert (a.hashes == repeats.strings_of(raw, ends, np.unique(own), length).hashes[np.isin(own, hot)]).all()


def test_anchors_are_looked_for_in_parts(monkeypatch):
    raw, ends = np.frombuffer(b"abcab" * 500 + bytes(range(65, 91)) * 40, np.uint8), np.array([700, 900, 3_540])
    want = repeats._own_anchors(raw, ends, 50)
    asked, real = [], repeats.gram_hashes
    monkeypatch.setattr(repeats, "gram_hashes", lambda raw, size: asked.append(len(raw)) or real(raw, size))
    for starts in (1, 64, 1_000):
        monkeypatch.setattr(repeats, "STARTS", starts, raising=False)
        asked.clear()
        assert all((x == y).all() for x, y in zip(repeats._own_anchors(raw, ends, 50), want, strict=True))
        assert max(asked) < starts + 50
