"""The ten operators on awkward documents, against plain Python, the tokenizer library and round trips."""

import hashlib
import random
import struct
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallygrid.llm import bpe, chat, components, decontam, exact_dedup, forest, fst, katz, langid, pretoken, queries, repeats, shared, urls
from tallygrid.workspace import settings

from . import brute

BPE, PIECES = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
ROWS = brute.texts()
UNIQUE = [(k, t) for k, (_, t) in enumerate(ROWS)]


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module", autouse=True)
def reachable(spark):
    shared.importable(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE)
    return t, [t.encode(x or "", add_special_tokens=False).ids for _, x in ROWS]


# 1


def rendered(rows, turns):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is None, t or 0, r is not None, r or "", x is not None, x or "", r))
    out = []
    for c, said in convs.items():
        said.sort(key=lambda x: x[:6])
        for who in {x[6] for x in said} - {None, "system"}:
            for lo in range(0, len(said), turns):
                text, spans, own = "", [], 0
                for *_, x, r in said[lo : lo + turns]:
                    text += "<|im_start|>" + ("assistant" if r == who else "system" if r == "system" else f"user name={r or 'unknown'}") + "\n"
                    if r == who:
                        spans.append(f"{len(text)}-{len(text) + len(x) + 10}")
                        own += 1
                    text += x + "<|im_end|>\n"
                out.append((c, who, lo // turns, len(said[lo : lo + turns]), own, text, ",".join(spans)))
    return sorted(out, key=repr)


def test_perspectives(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["ann", "bob", "cy", "system", None]), rng.choice(["hi", "", "é" * 9, None, "a\nb<|im_end|>"])) for c in range(6) for t in range(rng.randint(1, 9))]
    rows += [(50, t, rng.choice("abc"), f"t{t}") for t in range(150)] + [(51, 1, "a", "same")] * 7 + [(None, None, "a", "x"), (None, 1, "b", None), (52, 0, "system", "only")]
    df = brute.frame(spark, rows, "conv_id long, turn long, role string, text string", 5)
    cols = ("conv_id", "speaker", "part", "n_turns", "n_own", "text", "spans")
    assert rows_of(chat.perspectives(df, turns=16), *cols) == rendered(rows, 16)
    assert chat.perspectives(df.limit(0)).count() == 0


def test_perspectives_of_very_long_texts(spark):
    """In a short dialogue and in one of many parts; texts of one part are in one row, those of others aren't."""
    long = "é and so on " * 900_000  # 11 MB
    rows = [(1, 1, "a", long), (1, 2, "b", "short"), (1, 3, None, long[1:]), *((2, t, "ab"[t % 2], long[:1_000_000] if t == 100 else f"t{t}") for t in range(130))]
    found = rows_of(chat.perspectives(brute.frame(spark, rows, "conv_id long, turn long, role string, text string")), "conv_id", "speaker", "part", "n_turns", "n_own", "text", "spans")
    assert found == rendered(rows, chat.TURNS)


def test_short_dialogues_are_shuffled_once(spark):
    rows = [(c, t, "ab"[t % 2], f"turn {t} of {c}") for c in range(40) for t in range(6)]
    found = chat.perspectives(brute.frame(spark, rows, "conv_id long, turn long, role string, text string", 3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Join" not in plan


# 2


def test_exact_dedup_in_batches(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(brute.fold(t), []).append(i)
    want = []
    for i, t in ROWS:
        ids = groups[brute.fold(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i is not None and i == keep, hashlib.sha256(brute.fold(t).encode()).hexdigest()))
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(index.dedup(docs), *cols) == sorted(want, key=repr)
    # What is known is dropped, what is new is kept and appended; another handle on the same folder knows as much.
    again = exact_dedup.DigestIndex(spark, index.path, 3)
    more = spark.createDataFrame([(900, ROWS[1][1].translate({b: a for a, b in brute.AZ.items()})), (901, "brand new"), (902, "Brand New")], "doc_id long, text string")
    assert rows_of(again.dedup(more), *cols[:4]) == [(900, 1, 2, False), (901, 902, 2, False), (902, 902, 2, True)]
    assert again.rows().count() == len(groups) + 1 and again.rows().select("digest").distinct().count() == len(groups) + 1
    assert rows_of(exact_dedup.DigestIndex(spark).keep(more), "doc_id") == [(900,), (902,)]
    assert index.dedup(docs.limit(0)).count() == 0


def test_an_index_keeps_its_buckets(spark):
    """Opened by a session with other settings it knows as much; another number of buckets is refused."""
    texts = [(k, f"text {k}") for k in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    with settings(spark, {"spark.sql.shuffle.partitions": "8"}):
        index = exact_dedup.DigestIndex(spark)
        assert index.dedup(df).where("kept").count() == 200
    again = exact_dedup.DigestIndex(spark, index.path)
    assert again.buckets == 8
    found = again.dedup(df)
    assert found.count() == 200 and found.where("kept").count() == 0 and again.rows().groupBy("digest").count().count() == again.rows().count() == 200
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, index.path, 4)


def test_buckets_are_merged_and_read_in_order(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3, merge=3)
    for k in range(7):
        df = spark.createDataFrame([(100 * k + j, f"text {50 * k + j}") for j in range(100)], "doc_id long, text string")
        assert index.dedup(df).where("kept").count() == (100 if k == 0 else 50)
    assert 1 <= index.generation < 7 and index.rows().count() == 400 == exact_dedup.DigestIndex(spark, index.path).rows().count()
    index.compact()
    assert len(index.rows().inputFiles()) == 3
    digests = spark.createDataFrame([(b"x",)], "digest binary").hint("merge").join(index.rows().select("digest"), "digest", "left_anti")
    with settings(spark, {exact_dedup.IN_ORDER: "true"}):
        plan = digests._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Bucketed: true" in plan


def test_a_named_batch_can_be_added_again(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    first = rows_of(index.dedup(docs, batch="monday"), *cols)
    n = index.rows().count()
    assert rows_of(index.dedup(docs, batch="monday"), *cols) == first and index.rows().count() == n
    assert not any(r[3] for r in rows_of(index.dedup(docs, batch="tuesday"), *cols)) and index.rows().count() == n


def test_digests_fold_ascii_only(spark):
    found = exact_dedup.DigestIndex(spark).dedup(spark.createDataFrame([(1, "É"), (2, "é"), (3, "\u212a"), (4, "k"), (5, "K")], "doc_id long, text string"))
    assert rows_of(found, "doc_id", "group_size") == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)]


@pytest.mark.parametrize("stage", ["exact", "near"])
def test_one_row_of_each_text_stays(spark, stage):
    """With ids that are null or repeat, no text is lost and none stays twice."""
    a, b, c, d, e = (f"{x}0 {x}1 {x}2 {x}3 {x}4 {x}5" for x in "abcde")
    rows = [(5, a), (5, b), (9, b), (None, c), (None, d), (None, d), (7, d), (None, e), (None, e), (3, "x y z"), (3, "x y z"), (3, "x y z")]
    keep = forest.keep if stage == "near" else (index := exact_dedup.DigestIndex(spark, buckets=3)).keep
    df = brute.frame(spark, rows)
    found = keep(df)
    assert found.columns == df.columns
    assert rows_of(found, "doc_id", "text") == sorted([(5, a), (9 if stage == "exact" else 5, b), (None, c), (7, d), (None, e), (3, "x y z")], key=repr)
    if stage == "exact":  # a text that is known, also one first seen without an id, doesn't stay again
        assert rows_of(index.keep(brute.frame(spark, [(20, c), (None, a), (None, "new"), (21, "New")])), "doc_id", "text") == [(21, "New")]


# 3 and 9


def test_encoding_is_the_library_s(spark, docs, library):
    t, ids = library
    want = sorted(((i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _), x in zip(ROWS, ids)), key=repr)
    found = bpe.encode(docs, BPE, with_ids=True, lexicon_words=50).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found), key=repr) == want
    assert Counter(r["decoded"] for r in found) == Counter(x or "" for _, x in ROWS)
    assert bpe.encode(docs.limit(0), BPE).count() == 0


def test_counts_are_the_library_s(spark, docs, library):
    want = sorted(((i, len((x or "").encode()), len(n), len(n) > 512) for (i, x), n in zip(ROWS, library[1])), key=repr)
    assert rows_of(fst.count(docs, BPE), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert fst.count(docs.limit(0), BPE).count() == 0


AWKWARD = ["a", "B", "s", "t", "re", "ve", "ll", "'", "''", " ", "  ", "\n", "\r\n", "1", "!", "é", "日本", "😀", "\x00", "̀", "Ⅷ", "<|endoftext|>", "don't ", "՚", "ՠ", "Ᲊ", "zz" * 40]


def test_pieces_merges_and_chunks_on_random_texts(monkeypatch):
    rng = random.Random(1)
    strings = ["".join(rng.choice(AWKWARD) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["x" * 700, " " * 700]
    t, m, packed = Tokenizer.from_file(BPE), bpe.merges(BPE), pretoken.character_classes(BPE)
    want = [e.ids for e in t.encode_batch(strings, add_special_tokens=False)]
    lexicon = bpe.Lexicon.compile([w.encode() for w in ("a", "as", " a", "don", "'t", "zz", "")], m.encode)
    encoder, machine = bpe.Encoder(BPE, lexicon), fst.CountingTransducer(m)
    monkeypatch.setattr(fst, "CHUNK", 7)
    ids, counts = [[] for _ in strings], [0] * len(strings)
    for group in pretoken.parts(enumerate(strings), m.special, 4000):
        joined, at, ranges = pretoken.split(group, packed)
        words = [joined[a:b] for a, b in zip(at, at[1:])]
        known = {w: machine.run(w.encode())[1] for w in {*words} if len(w) <= fst.CHUNK}
        for part, (lo, hi) in zip(group, ranges):
            got = struct.pack("<I", m.special_id) * part.special + b"".join(map(encoder.learn(words).__getitem__, words[lo:hi]))
            ids[part.row] += struct.unpack(f"<{len(got) // 4}I", got)
            counts[part.row] += part.special + fst._count_part(machine, known, joined, at, words, lo, hi)
    assert ids == want and counts == [*map(len, want)]


def test_long_texts_are_counted_by_maps_of_many_tasks(spark, library, monkeypatch):
    """Chunks that end anywhere, also within pieces that go on through several; their maps lead where the whole text does."""
    rng = random.Random(11)
    texts = ["".join(rng.choice(AWKWARD) for _ in range(400)), "ab" * 900 + " " + "xyz" * 700, "é日本" * 500, "short", "", None, "<|endoftext|>" * 30 + "don't " * 200]
    monkeypatch.setattr(fst, "SPLIT", 600)
    monkeypatch.setattr(fst, "DEALT", 97)
    want = sorted(((k, len((x or "").encode()), len(library[0].encode(x or "", add_special_tokens=False).ids)) for k, x in enumerate(texts)), key=repr)
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2)
    assert rows_of(fst.count(df, BPE), "doc_id", "n_bytes", "n_tokens") == want


def test_state_maps_compose():
    m = fst.CountingTransducer(bpe.merges(BPE))
    word = ("internationalization" * 40).encode()
    parts = [word[k : k + 37] for k in range(0, len(word), 37)]
    maps = [fst.chunk_map(m, word[max(0, 37 * k - fst.BEFORE) : 37 * k], x, None) for k, x in enumerate(parts)]
    assert all(len(x.to) >= 1 for x in maps)
    for k, x in enumerate(fst.scan(maps)):
        assert x(0) == m.run(word[: 37 * (k + 1)])
    # What bytes before tell is, but for the first few chunks' sake, the true state: nothing has to be run again.
    assert sum(m.run(word[: 37 * k])[0] in maps[k].to for k in range(len(parts))) >= len(parts) - 1
    other = fst.CountingTransducer(bpe.merges(BPE))
    state, _ = m.run(b"internat")
    assert other.run(b"ional", other.of_key(m.key(state)))[1] == m.run(b"ional", state)[1]


def test_lexicon_finds_its_words_and_no_others(tmp_path):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))).encode() for _ in range(400)}
    lexicon = bpe.Lexicon.compile(words, lambda w: [*w])
    (tmp_path / "x").write_bytes(lexicon.dump())
    mapped = bpe.Lexicon.open(str(tmp_path / "x"))
    asked = [*words, b"abcabcabca", b"", b"d", *(w + b"z" for w in words)]
    assert mapped.find(asked).tolist() == [sorted(words).index(w) if w in words else -1 for w in asked]
    assert len(lexicon.final) < sum(map(len, words)) / 2  # suffixes are shared


# 4


def test_near_duplicates_match_all_pairs(spark):
    df = brute.frame(spark, UNIQUE)
    cols = ("doc_id", "class_id", "class_size", "n_links", "n_shingles")
    want = sorted(brute.near(UNIQUE), key=repr)
    found = forest.classes(df).cache()
    assert rows_of(found, *cols) == want
    assert found.where("stands").count() == len({c for _, c, *_ in want})
    kept = forest.keep(df)
    assert kept.columns == df.columns and rows_of(kept, "doc_id") == sorted(((c,) for c in {c for _, c, *_ in want}), key=repr)
    assert forest.classes(df.limit(0)).count() == 0
    assert forest.classes(brute.frame(spark, ROWS)).count() == len(ROWS)


def test_large_components_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(60):
        x = list(base)
        x[rng.randrange(80)] = f"y{k}"
        rows.append((k, " ".join(x)))
    monkeypatch.setattr(forest, "TOGETHER", 16)
    assert rows_of(forest.classes(brute.frame(spark, rows)), "doc_id", "class_id", "class_size", "n_links", "n_shingles") == sorted(brute.near(rows), key=repr)


def test_depth_and_trees_follow_the_recall():
    d = forest.matched_depth()
    assert 1 - (1 - 0.8**d) ** forest.TREES >= forest.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** forest.TREES
    assert forest.matched_depth(recall=1.0) == 1 and forest.matched_depth(recall=0.5) == forest.DEPTH
    assert forest.trees_for() == forest.TREES and 1 - 0.9 ** forest.trees_for(0.1) >= forest.RECALL > 1 - 0.9 ** (forest.trees_for(0.1) - 1)
    # Pairs far above the similarity are found by whole signatures; many that are just at it ask for shorter prefixes.
    assert forest.found_share({0.95: 1000}, 8, 32) > forest.RECALL > forest.found_share({0.95: 1000, 0.8: 900}, 8, 32)
    assert forest.found_share({0.8: 1}, d, 32) >= forest.RECALL and forest.found_share({}, 8, 32) == 0  # nothing found tells nothing


def varied(rng, words, n, changed):
    """n texts, each with its own words at so many places."""
    out = []
    for k in range(n):
        x = list(words)
        for j in rng.sample(range(len(x)), changed):
            x[j] = f"y{k}x{j}"
        out.append(" ".join(x))
    return out


def parts_of(spark, texts):
    sets = forest.shingles([x.encode() for x in texts])
    return sets, *forest.signatures(sets, forest.TREES)


def test_signatures_and_sketches_tell_the_similarity(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base), *varied(rng, base, 3, 4), *varied(rng, base, 3, 20), "x y z"]
    sets, signature, sketch = parts_of(spark, texts)
    told = forest.alike(sketch, sketch, forest.TREES * forest.DEPTH)
    for a in range(7):
        for b in range(7):
            true = len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
            assert abs(told[a, b] - true) < 0.2 and abs((signature[a] == signature[b]).mean() - true) < 0.12
    assert abs(told[0, 7]) < 0.35


def test_prefixes_are_shortened_only_as_the_data_ask(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    seen = []
    real = forest.candidates
    monkeypatch.setattr(forest, "candidates", lambda *a: seen.append(real(*a)) or seen[-1])
    forest.classes(brute.frame(spark, list(enumerate(varied(rng, base, 12, 1))))).count()
    assert seen[-1][1] == forest.DEPTH
    forest.classes(brute.frame(spark, list(enumerate(varied(rng, base, 12, 2))))).count()
    assert seen[-1][1] < forest.DEPTH


def test_unlike_texts_that_meet_are_not_joined(spark):
    """Texts that share 0.3 of their shingles meet in some tree, but no edge joins them."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(92)]
    rows = [(k, " ".join([*common, *(f"z{k}x{j}" for j in range(100))])) for k in range(150)]
    assert 0.25 < len((a := brute.shingles(rows[0][1])) & (b := brute.shingles(rows[1][1]))) / len(a | b) < 0.35
    _, signature, sketch = parts_of(spark, [t for _, t in rows])
    keys = forest.prefixes(signature, forest.matched_depth())
    met = sum(len(x) - len(np.unique(x)) for x in keys.T)
    one, other, _ = forest._joined(np.arange(150), sketch, forest.TREES * forest.DEPTH)
    assert met > 100 and len(one) < 25  # of 11,175 pairs
    found = forest.classes(brute.frame(spark, rows))
    assert found.where("n_links = 0 AND class_size = 1").count() == 150


def test_leaders_stand_for_large_groups(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = list(enumerate(varied(rng, base, 90, 2) + varied(rng, base, 30, 9)))
    monkeypatch.setattr(forest, "GROUP", 10)
    cols = ("doc_id", "class_id", "class_size", "n_links", "n_shingles")
    assert rows_of(forest.classes(brute.frame(spark, rows)), *cols) == sorted(brute.near(rows), key=repr)


def test_frequent_words_are_found_without_ordering_all(spark):
    rows = [(f"w{k}".encode(), 1 + 3_000 // (k + 1)) for k in range(3_000)] + [(f"twice{k}".encode(), 2) for k in range(4_000)]
    counts = spark.createDataFrame(rows, "word binary, n long").repartition(3)
    for words in (10, 100, 1_000, 3_000, 10_000):
        found = {bytes(r["word"]): r["n"] for r in bpe.frequent(counts, words).collect()}
        able = sorted((n for _, n in rows if n > 1), reverse=True)
        assert 0.8 * min(words, len(able)) - 5 <= len(found) <= 1.1 * words + 5
        least = able[min(words, len(able)) - 1]
        assert all(found.get(w) == n for w, n in rows if n > 2 ** (1 / 8) * least and n > 1)
    assert bpe.frequent(counts.limit(0), 5).count() == 0


@pytest.mark.parametrize("similarity, group", [(0.3, 4_096), (0.3, 10), (0.5, 10), (0.85, 10)])
def test_other_similarities(spark, monkeypatch, similarity, group):
    """No link that isn't one, and nearly all that are, also by way of leaders."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    rows = list(enumerate(x for n in (1, 2, 4, 7, 11, 16, 22) for x in varied(rng, base, 10, n)))
    monkeypatch.setattr(forest, "GROUP", group)
    found = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in forest.classes(brute.frame(spark, rows), similarity=similarity).collect()}
    want = {i: (n, c) for i, c, _, n, _ in brute.near(rows, similarity)}
    assert all(found[i][0] <= want[i][0] for i in want) and sum(n for n, _ in want.values()) > 20
    assert sum(n for n, _ in found.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_a_single_pair_at_the_similarity_is_found(spark):
    """None is nearer, so that whole signatures find nothing; prefixes are shortened all the same."""
    words = [f"w{k}" for k in range(95)]
    for seed in range(3):
        other = list(words)
        for j in (20 + seed, 60 + seed):
            other[j] = "x"
        a, b = brute.shingles(" ".join(words)), brute.shingles(" ".join(other))
        assert 0.8 <= len(a & b) / len(a | b) < 0.82
        rows = [(1, " ".join(words)), (2, " ".join(other)), *((k, " ".join(f"z{k}x{j}" for j in range(60))) for k in range(3, 30))]
        assert forest.classes(brute.frame(spark, rows)).where("n_links = 1 AND class_id = 1").count() == 2


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 240)] + [(None, 1), (3, 3)]
    sets = brute.Sets()
    for a, b in edges:
        if a is not None and a != b:
            sets.join(a, b)
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert rows_of(found, "node", "component") == sorted(((x, sets.root(x)) for x in list(sets)), key=repr)


# 5


def test_decontamination(spark, docs):
    long = ROWS[1][1].split()
    items = [(1, " ".join(long[3:20])), (2, "A b. C"), (3, None), (4, ""), (5, "nowhere at all"), (6, "é"), (None, " ".join(long[5:16])), (7, " ".join(ROWS[2][1].split()[:10])), (7, "a b c d"), (80, " ".join(long[3:14])), (9, "1 2 3 4 5")]
    bench = brute.frame(spark, items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(brute.decontaminate(ROWS, items), key=repr)
    assert rows_of(decontam.find(docs, bench), *cols) == want
    assert sum(w[5] for w in want) > 5
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)


def test_decontamination_makes_no_rows_in_python(spark, monkeypatch):
    """They would start a second group of workers on each executor, beside those that other stages left."""
    rows = [(1, "one two three four five six seven eight nine ten eleven"), (2, "one two three")]
    docs, items = brute.frame(spark, rows), brute.frame(spark, [("a", rows[0][1])], "item_id string, text string")
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    assert {r["doc_id"]: r["n_hit"] for r in decontam.find(docs, items).collect()} == {1: 11, 2: 0}


def test_decontamination_of_nothing(spark, docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.find(docs.limit(0), bench).count() == 0
    assert decontam.find(docs, bench.limit(0)).where("n_hit = 0 AND NOT contaminated").count() == len(ROWS)


# 6


def repeating():
    rng = random.Random(9)
    base = "".join(rng.choice("ab cdé") for _ in range(2500))
    fill = lambda: "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))
    rows = [(i, fill() + base[(a := rng.randint(0, 2000)) : a + rng.randint(100, 450)] + fill()) for i in range(60)]
    return [*rows, (900, None), (901, ""), (902, "a" * 900), (904, "abc" * 200), (905, "\x00" * 400), (905, "\x00" * 400), (None, base[:300]), (906, base[:300]), (907, base[:300])]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats(spark, hot):
    """Also where all anchors are too frequent, and are replaced by their strings."""
    rows = repeating()
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(repeats.dedup(brute.frame(spark, rows), hot=hot), *cols) == sorted(brute.repeats(rows, 200), key=repr)
    if hot > 1:
        assert repeats.dedup(brute.frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats_come_with_all_their_occurrences(spark, hot):
    rows, length = [(k, t) for k, (_, t) in enumerate(repeating())], 60
    raws = {k: (t or "").encode() for k, t in rows}
    found = {}
    for r in repeats.repeat_groups(brute.frame(spark, rows), length=length, hot=hot).collect():
        assert raws[r["doc_id"]][r["start"] : r["start"] + r["n_bytes"]] and 0 <= r["start"]
        found.setdefault(r["repeat"], set()).add((r["doc_id"], r["start"], r["n_bytes"]))
    covered = {k: [False] * len(x) for k, x in raws.items()}
    reach, seen = 2 * length - repeats.GRAM, set()
    for group in found.values():
        strings = {raws[k][a : a + n] for k, a, n in group}
        assert len(strings) == 1 and len(one := strings.pop()) >= length and one not in seen
        seen.add(one)
        everywhere = {(k, a, len(one)) for k, x in raws.items() for a in range(len(x) - len(one) + 1) if x.startswith(one, a)}
        assert group == everywhere and len(group) > 1
        before, after = ({raws[k][a - 1 : a] if a else k for k, a, _ in group}, {raws[k][a + n : a + n + 1] or k for k, a, n in group})
        # Not all go on alike to a side, unless the string goes on for as far as is compared.
        assert (len(before) > 1 and len(after) > 1) or len(one) >= length
        if len(before) == 1 and len(after) == 1:
            assert len(one) >= length and len(one) <= reach + repeats.GRAM
        for k, a, n in group:
            covered[k][a : a + n] = [True] * n
    gone = {r[0]: r[2] for r in brute.repeats(rows, length)}
    assert {k: sum(x) for k, x in covered.items()} == gone


# 7


def close(found, want):
    found, want = (sorted(map(tuple, x), key=lambda r: repr(r[:5]) + f"{r[5]:.6f}") for x in (found, want))
    for a, b in zip(found, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def said(seed, n):
    """Texts of few words, so that contexts of several words come again."""
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(["a", "b", "c", "d", "the", "X"] if rng.random() < 0.9 else ["rare", f"r{rng.randrange(40)}"]) for _ in range(rng.randint(0, 30)))) for k in range(n)]


def test_katz(spark, docs):
    want, model = brute.katz_scores(ROWS)
    close(katz.score(docs).collect(), want)
    for context in [c for c in model.follow if c][:20]:  # every context's distribution sums to one, with the unknown word
        assert sum(model.p(context, w) for w in model.one) + model.p(context, "unknown") == pytest.approx(1)
    assert katz.score(docs.limit(0)).count() == 0
    assert [tuple(r)[2:] for r in katz.score(docs.where("doc_id IS NULL AND text IS NULL")).collect()] == [(1, 0, 0, 0.0, 0.0)]


@pytest.mark.parametrize("order", [1, 3, 4])
def test_katz_of_any_order(spark, order):
    rows = [*said(3, 70), (None, "a b the"), (7, "a b c d"), (8, None)]
    close(katz.score(brute.frame(spark, rows), order=order).collect(), brute.katz_scores(rows, order)[0])


def test_katz_tables_hold_the_model_and_score_other_texts(spark):
    rows, others = said(3, 60), [*said(4, 25), (None, None), (5, "never seen words a b c")]
    _, brute_model = brute.katz_scores(rows, 3)
    model = katz.fit(brute.frame(spark, rows), order=3)
    close(model.score(brute.frame(spark, others)).collect(), brute.katz_scores(others, 3, rows)[0])
    words = {r["number"]: r["count"] for r in model.words().collect()}
    hashes = {katz.xxhash.xxh3_64_intdigest((w or " ").encode()): w for w in brute_model.one}
    name = {r["number"]: hashes[r["hash"] % (1 << 64)] for r in model.words().collect()}
    assert {name[k]: c for k, c in words.items()} == dict(brute_model.one)
    context = {katz.BEGIN: ("<begin>",)} | {k: (w,) for k, w in name.items()}
    for order in (2, 3):
        found, numbers = {}, {}
        for r in model.grams(order).collect():
            gram = (*context[r["context"]], name[r["word"]])
            found[gram], numbers[r["number"]] = r["count"], gram
        assert found == {(*c, w): n for c, f in brute_model.follow.items() if len(c) == order - 1 for w, n in f.items()}
        weights = {context[r["context"]]: (r["times"], r["weight"]) for r in model.weights(order).collect()}
        assert weights == {c: (sum(f.values()), pytest.approx(brute_model.weight(c))) for c, f in brute_model.follow.items() if len(c) == order - 1 and f}
        context = numbers


def test_katz_deals_hot_contexts_over_buckets(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(f"the w{rng.randrange(400)}" for _ in range(40))) for k in range(60)]
    for order in (2, 3):
        close(katz.score(brute.frame(spark, rows), order=order).collect(), brute.katz_scores(rows, order)[0])


def test_discounts_stay_between_0_and_1():
    for times in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 9, 9, 9, 9], [100, 50, 30, 20, 15, 12]):
        d = katz.discounts(times)
        assert ((d > 0) & (d <= 1)).all() and d[-1] == 1


# 8


def test_language(spark):
    rng = random.Random(5)
    letters = {"xx": "abcdef", "yy": "efghij", "zz": "klmnop"}
    rows = []
    for k in range(240):
        lang = rng.choice([*letters])
        rows.append((k, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 40))), lang))
    truth = {k: lang for k, _, lang in rows}
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "123 !? _ ²", "xx"), (None, "abc abd", "xx"), (904, "q" * 500, None), (905, "abcd fedc", None)]
    df = brute.frame(spark, rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.predict(df, PIECES, sample=60).collect()}
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found.values())
    held = [k for k in truth if found[k]["held_out"]]
    assert sum(found[k]["lang_pred"] == truth[k] for k in held) >= 0.95 * len(held) > 20
    assert [found[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and found[905]["lang_pred"] == "xx"
    kept = langid.accept(df, PIECES, sample=60)
    assert kept.columns == df.columns and not {900, 901, 902} & {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert langid.predict(df.limit(0), PIECES).count() == 0
    assert {r["lang_pred"] for r in langid.predict(df.withColumn("lang", F.lit(None).cast("string")), PIECES).collect()} == {"und"}


def test_predictions_by_all_segmentations_written_out(spark, monkeypatch):
    rng = random.Random(15)
    letters = {"xx": "abcdeé", "yy": "defgh", "zz": "xyzabc"}
    rows = [(k, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 6))), lang) for k, lang in enumerate(rng.choice([*letters]) for _ in range(50))]
    rows += [(900, "日本 abc", None), (901, "... 12", "xx"), (902, None, "yy"), (None, "abd", "xx")]
    own = {x: k for x, k in langid.pieces(PIECES).items() if k > 0}
    want = {i: x for i, *x in brute.language(rows, own, langid.ROUNDS, langid.ADDED)}
    found = langid.predict(brute.frame(spark, rows, "doc_id long, text string, lang string"), PIECES).collect()
    assert {r["doc_id"]: [r["lang_pred"], r["score"]] for r in found} == {i: [lang, pytest.approx(x)] for i, (lang, x) in want.items()}
    # Long words are walked another way, with the same sums.
    monkeypatch.setattr(langid, "WORD", 2)
    languages, p = langid.fit(brute.frame(spark, rows, "doc_id long, text string, lang string"), PIECES)
    scorer = langid.Scorer(languages, p, langid.pieces(PIECES))
    import pyarrow as pa

    preds, scores = scorer.judge_all(pa.array([t for _, t, _ in rows]))
    assert preds == [want[i][0] for i, *_ in rows] and scores == pytest.approx([want[i][1] for i, *_ in rows])


def test_five_hundred_documents_of_a_language_are_learnt_from_in_four_rounds(spark):
    rows = [(k, "".join(chr(97 + int(d)) for d in str(k)), "xx") for k in range(600)]
    words = langid.training_words(brute.frame(spark, rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", langid.SAMPLE_DOCS)
    assert words.count() == sum(not langid.held_out(k) for k, *_ in rows) > 400
    assert langid.ROUNDS >= 4


def test_forward_sums_all_segmentations():
    vocab = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5, "ba": 6}
    p = np.random.default_rng(1).random((7, 2))
    p /= p.sum(0)

    def total(w, k):
        return 1.0 if not w else sum(p[vocab.get(w[:n], 0), k] * total(w[n:], k) for n in range(1, len(w) + 1) if w[:n] in vocab or n == 1)

    words = ["ab", "aba", "", "bxab"]
    lattice = langid.Lattice(words, langid.with_beginnings([*vocab]))
    assert lattice.total(p) == pytest.approx(np.array([[total("▁" + w, k) for k in range(2)] for w in words]))
    counts = lattice.expected(p, np.ones((4, 2)))  # each word's pieces have its characters
    size = np.array([1] + [len(x) for x in vocab])
    assert (counts * size[:, None]).sum(0) == pytest.approx([sum(len(w) + 1 for w in words)] * 2)


def test_long_runs_and_long_pieces_are_not_cut():
    vocab = langid.with_beginnings(["▁", "a", "b", "ab", "▁a", "ba", "bab" * 6])
    rng = np.random.default_rng(2)
    p = rng.random((max(vocab.values()) + 1, 3))
    p /= p.sum(0)
    words = ["ab" * 20, "bab" * 9 + "x", "a", "abx" * 30]
    lattice, runs, n = langid.Lattice(words, vocab), langid.Runs(words, vocab), rng.random((4, 3))
    assert runs.log_total(p) == pytest.approx(np.log(lattice.total(p)))
    assert runs.expected(p, n) == pytest.approx(lattice.expected(p, n))
    # Far beyond what a product of probabilities can hold: twice the letters, twice the logarithm, about.
    one, two = langid.Runs(["ab" * 3000, "ab" * 6000], vocab).log_total(p)
    assert np.isfinite(two).all() and two == pytest.approx(2 * one, rel=0.01)
    assert langid.words_of("x" * 100) == ["x" * 100]
    assert max(map(len, langid.pieces(PIECES))) > 12
    scorer = langid.Scorer(["x", "y", "z"], p, vocab)
    assert scorer.learn({*words}) is None and scorer.logs[[scorer.place[w] for w in words]] == pytest.approx(np.log(lattice.total(p)))



# 10


def test_url_aliases(spark):
    link = '<html><LINK href="{}" rel="canonical"><p></html>'
    hop = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://a.net/x", link.format("https://b.example.org/es/1")), (2, "http://c.net/y?q=1#f", hop.format("http://a.net/x")), (3, "https://z.org/q", link.format("http://C.net/y?q=1")),
        (4, "http://lone.net/", None), (5, None, link.format("/r")), (6, "nohost", link.format("http://a.net/x")), (7, "http://d.net/a/b", link.format("c")), (8, "http://d.net/a/c", ""),
        (9, "https://www.Example.org/en/12?x", ""), (10, "http://org/", ""), (11, "http://notexample.org", ""), (12, "https://shop.com/de/1", ""), (13, "http://e.net/1", link.format("//d.net/a/c")),
        (14, "http://d.net/a/c", hop.format("https://shop.com/de/9")), (2, "http://c.net/y?q=1#f", ""), (None, "http://f.net/?a", ""),
    ]
    found = rows_of(urls.judge(brute.frame(spark, rows, "page_id long, url string, html string"), queries.URL_RULES), "page_id", "host", "path", "rule", "verdict")
    want = [
        (1, "a.net", "/x", None, "block"), (2, "c.net", "/y", None, "block"), (2, "c.net", "/y", None, "block"), (3, "z.org", "/q", "org/", "allow"), (4, "lone.net", "/", None, "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "d.net", "/a/b", None, "block"), (8, "d.net", "/a/c", None, "block"), (9, "www.example.org", "/en/12", "example.org/en/1", "block"),
        (10, "org", "/", "org/", "allow"), (11, "notexample.org", "", None, "allow"), (12, "shop.com", "/de/1", "com/de/", "block"), (13, "e.net", "/1", None, "block"), (14, "d.net", "/a/c", None, "block"),
        (None, "f.net", "/", None, "allow"),
    ]
    assert found == sorted(want, key=repr)
    none = brute.frame(spark, rows, "page_id long, url string, html string").limit(0)
    assert urls.judge(none, queries.URL_RULES).count() == 0
    assert urls.judge(brute.frame(spark, rows, "page_id long, url string, html string"), []).where("verdict = 'allow' AND rule IS NULL").count() == len(rows)


def test_a_very_long_word_stays_out_of_the_lexicon(spark):
    """Megabytes without a blank are merged, not compiled; ids are the library's all the same."""
    rows = [(1, "ab" * 1_000_000), (2, "a b " + "xyz" * 200)]
    lexicon = bpe.compile_lexicon(brute.frame(spark, rows), BPE)
    assert len(lexicon.final) < 2 * bpe.LEXICON_BYTES
    t = Tokenizer.from_file(BPE)
    found = {r["doc_id"]: r["n_tokens"] for r in bpe.encode(brute.frame(spark, rows), BPE).collect()}
    assert found == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in rows}


def test_caches_begin_anew_within_their_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5_000)
    encoder, m = bpe.Encoder(BPE, bpe.Lexicon.compile([], lambda w: [])), bpe.merges(BPE)
    for k in range(40):
        words = [f"w{k}-{j}" for j in range(10)]
        known = encoder.learn(words)
        assert all(known[w] == struct.pack(f"<{len(ids := m.encode(w.encode()))}I", *ids) for w in words)
        assert encoder.size <= 5_000 + 10 * 300 and len(known) < 60
    monkeypatch.setattr(langid, "REMEMBERED", 3_000)
    vocab = langid.with_beginnings(["▁", "a", "b"])
    scorer = langid.Scorer(["x"], np.full((4, 1), 0.25), vocab)
    for k in range(40):
        scorer.learn({w := "ab" * (k + 1)})
        assert scorer.logs[scorer.place[w]] == pytest.approx((2 * k + 3) * np.log(0.25)) and len(scorer.place) < 30


def test_url_aliases_by_brute_force(spark):
    """Random pages: targets by the standard library, groups by disjoint sets, verdicts by trying all rules."""
    from html import unescape
    from urllib.parse import urljoin, urlsplit

    rng = random.Random(12)
    hosts = ["a.net", "b.org", "x.example.org", "c.com", "Shop.com"]
    paths = ["/", "/es/1", "/en/12", "/de/x", "/fr/y", "/q/r/s", "/q/r/", "/p?z=1&w=2"]
    urls_of = [f"http://{h}{p}" for h in hosts for p in paths]
    targets = ["../t", "./u", "/de/../v", "s/./w", "?k=1&amp;l=2", "//a.net/p", "https://c.com/de/x", "http://Shop.com/fr/y", "../../../up"]
    form = ['<link rel="alternate canonical" href="{}">', "<LINK href='{}' rel=canonical >", '<meta content="5; URL={}" http-equiv=Refresh>', '<!-- <link rel="canonical" href="{}"> -->', '<link rel="stylesheet" href="{}">']
    rows, sets, address = [], brute.Sets(), lambda u: (p := urlsplit(u)).netloc.lower() + p.path + (f"?{p.query}" if p.query else "")
    for k in range(120):
        url, kind, target = rng.choice(urls_of), rng.randrange(5), rng.choice([*targets, *urls_of[:6]])
        rows.append((k, url, f"<p>{form[kind].format(target)}</p>" if rng.random() < 0.3 else ""))
        if rows[-1][2] and kind < 3:
            sets.join(address(url), address(urljoin(url, unescape(target))))

    def rule(u):
        host, path = address(u).split("?")[0].partition("/")[::2]
        fits = [(len(h + p), v, h + p) for v, h, p in queries.URL_RULES if (host == h or host.endswith(f".{h}")) and f"/{path}".startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    bad = {sets.root(x) for x in list(sets) if rule(f"http://{x}")[0] == "block"}
    want = []
    for k, url, _ in rows:
        verdict, name = rule(url)
        want.append((k, name, verdict or ("block" if sets.root(address(url)) in bad else "allow")))
    found = urls.judge(brute.frame(spark, rows, "page_id long, url string, html string"), queries.URL_RULES)
    assert rows_of(found, "page_id", "rule", "verdict") == sorted(want, key=repr)
    assert found.where("alias_blocked AND rule IS NULL").count() > 3
