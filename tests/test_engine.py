"""Searches against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallygrid.config import Config
from tallygrid.operators import clusters, points, predicates, stats, topk
from tallygrid.operators.match import match, match_positions
from tallygrid.plans import engine
from tallygrid.sources import index
from tallygrid.sources.rows import from_csr, from_rows

random.seed(5)
VECTORS = [[random.randint(0, 12) for _ in range(4)] for _ in range(40)]
BAGS = [[random.randint(0, 30) for _ in range(random.randint(1, 25))] for _ in range(30)]
SEQUENCES = [[random.randint(3, 6) for _ in range(random.randint(1, 30))] for _ in range(25)] + [[], [4] * 90, [4] * 80]


def ranked(counts: dict, k: int, skip: int = 0):
    by = {}
    for (q, *i), c in counts.items():
        if c:
            by.setdefault(q, []).append((-c, *i))
    return {q: [(*i, -c) for c, *i in sorted(x)[skip : skip + k]] for q, x in by.items() if len(x) > skip}


def got(df, *cols):
    out = {}
    for r in df.orderBy("qid", "rnk").collect():
        out.setdefault(r["qid"], []).append((r["id"], *(r[c] for c in cols), r["cnt"]))
    return out


def ask(spark, rows, n=5):
    return from_rows(spark, rows).where(F.col("id") < n)


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_vectors(spark, radius):
    want = Counter({(q, i): sum(abs(a - b) <= radius for a, b in zip(VECTORS[q], x)) for q in range(5) for i, x in enumerate(VECTORS)})
    at = points.vector_points(from_rows(spark, VECTORS))
    found = engine.match_queries(at, engine.build_queries(ask(spark, VECTORS), Config(6, 5, radius or None)), Config(6, 5, radius or None))
    assert got(found) == ranked(want, 6)


def test_wide_ranges_several_ranges_and_pages(spark):
    at = points.vector_points(from_rows(spark, [[x[0] * 5000, x[1]] for x in VECTORS]))
    rows = [(7, 0, 0, 0, 30_000, 1.0, 0.0), (7, 0, 0, 10_000, 60_000, 2.0, 0.0), (7, 1, 1, 3, 3, 1.0, 0.0), (9, 0, 5, 0, 9, 1.0, 0.0), (9, 0, 1, 5, 4, 1.0, 0.0), (9, 0, 1, -9, 0, 1.0, 0.0)]
    preds = spark.createDataFrame(rows, "qid long, ord int, dim int, lo int, up int, weight double, selectivity double")
    count = lambda x, w: (0 <= x[0] * 5000 <= 30_000) + w * (10_000 <= x[0] * 5000 <= 60_000) + (x[1] == 3)
    for w, weighted in ((1, False), (2, True)):
        want = {(7, i): count(x, w) for i, x in enumerate(VECTORS)} | {(9, i): x[1] <= 0 for i, x in enumerate(VECTORS)}
        found = match(at, predicates.valid(preds, 2), weighted=weighted)
        assert got(topk.top_k(found, 50)) == ranked(want, 50)
        assert got(topk.top_k(found, 4, page=2)) == ranked(want, 4, 4)
    assert match_positions(at, predicates.valid(preds, 2)).count() == sum(count(x, 1) + (x[1] <= 0) for x in VECTORS)


def test_ties_at_k_padding_and_order(spark):
    at = points.vector_points(from_rows(spark, [[1, 1]] * 8 + [[0, 1]]))
    preds = predicates.radius_predicates(from_rows(spark, [[1, 1], [5, 5]]))
    found = match(at, preds, exact=True)
    assert got(topk.top_k(found, 3)) == {0: [(0, 2), (1, 2), (2, 2)]}
    assert got(topk.top_k(found, 3, descending_ids=True)) == {0: [(7, 2), (6, 2), (5, 2)]}
    assert got(topk.pad(topk.top_k(found, 10), preds, 10)) == {0: [(i, 2) for i in range(8)] + [(8, 1), (0, 0)], 1: [(0, 0)] * 10}
    assert got(topk.top_k(match(at, preds, exact=True, cap=1), 1)) == {0: [(0, 1)]}


def test_bags_multiply(spark):
    want = {(q, i): sum(Counter(BAGS[q])[t] * n for t, n in Counter(x).items()) for q in range(5) for i, x in enumerate(BAGS)}
    data, queries = from_rows(spark, BAGS), ask(spark, BAGS)
    assert got(engine.search_bags(data, queries, 7)) == ranked(want, 7)
    assert got(engine.search_bags(data, queries, 7, cap=4)) == ranked({k: min(c, 4) for k, c in want.items()}, 7)


def test_sequences_take_the_least(spark):
    def runs(x, n=3):
        x = x + [x[0]] * max(0, n - len(x)) if x else x
        return Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))

    def common(q, d):
        # Data has occurrences from 63 on as one; queries drop those above.
        return sum(sum(min(k, 63) == j for k in range(d[g]) for j in range(min(n, 64))) for g, n in q.items())

    asked = [0, 1, 2, 25, 26, 27]
    want = {(q, i): common(runs(SEQUENCES[q]), runs(x)) for q in asked for i, x in enumerate(SEQUENCES)}
    data = from_rows(spark, SEQUENCES)
    assert got(engine.search_sequences(data, data.where(F.col("id").isin(asked)), 6)) == ranked(want, 6)


def test_queries_beyond_the_values_are_cut_before_runs(spark):
    data, query = from_rows(spark, [[3, 4, 5]]), from_rows(spark, [[3, 99, 4, 5]])
    assert got(engine.search_sequences(data, query, 1)) == {0: [(0, 1)]}


def test_subsequences(spark):
    want = Counter()
    for q in range(3):
        for i, x in enumerate(BAGS):
            for a, t in enumerate(BAGS[q]):
                for b, u in enumerate(x):
                    if t == u and b >= a:
                        want[q, i, b - a] += 1
    assert got(engine.search_subsequences(from_rows(spark, BAGS), ask(spark, BAGS, 3), 5), "offset") == ranked(want, 5)


def grown(lo, up, need, values):
    n, least, most = Counter(values), min(values), max(values)
    inside = lambda v: least <= v <= most
    while sum(c for v, c in n.items() if lo <= v <= up) < need:
        if lo > 0:
            lo -= 1
            if not inside(lo):
                continue
        if inside(up + 1):
            up += 1
        elif lo <= 0:
            break
    return lo, up


def test_adaptive_ranges(spark, monkeypatch):
    rng = random.Random(2)
    for least in (0, 4):
        for _ in range(300):
            values = [rng.randint(least, least + rng.randint(0, 15)) for _ in range(20)]
            lo = rng.randint(0, 25)
            up = lo + rng.randint(0, 3)
            need = rng.randint(1, 25)
            c = Counter(values)
            keys = sorted(c)
            import numpy as np

            assert predicates.widened(lo, up, need, np.array(keys), np.cumsum([c[k] for k in keys])) == grown(lo, up, need, values), (lo, up, need, values)
    at = points.vector_points(from_rows(spark, VECTORS))
    for rows in (predicates.HISTOGRAM_ROWS, 1):  # both when all counts are sent to every task and when they stay where they are
        monkeypatch.setattr(predicates, "HISTOGRAM_ROWS", rows)
        found = predicates.widen(predicates.radius_predicates(ask(spark, VECTORS)), at, 0.3).collect()
        assert len(found) == 20
        for r in found:
            v = VECTORS[r["qid"]][r["dim"]]
            assert (r["lo"], r["up"]) == grown(v, v, math.ceil(0.3 * 40), [x[r["dim"]] for x in VECTORS])


def test_multirange_takes_the_first_queries(spark):
    at = points.vector_points(from_rows(spark, VECTORS))
    rows = spark.createDataFrame([(5, 0, 3, 0.0, 1.0), (5, 0, 8, 0.5, 1.0), (2, 1, 4, 0.0, 1.0), (9, 1, 4, 0.0, 1.0)], "qid int, dim int, value int, selectivity float, weight float")
    found = predicates.multirange(rows, at, 2)
    assert {r["qid"] for r in found.collect()} == {2, 5} and found.where("lo < up").count() == 1
    assert predicates.multirange(rows, at, 0).count() == 0


def test_chunks_clusters_and_tables(spark):
    at = points.vector_points(from_rows(spark, VECTORS))
    preds = predicates.radius_predicates(ask(spark, VECTORS))
    whole = got(topk.top_k(match(at, preds), 5))
    assert got(engine.search_chunks(at, preds, 5, 7)) == whole
    halves = [at.where("id < 15"), at.where("id >= 15").withColumn("id", F.col("id") - 15)]
    found = engine.search_tables(halves, preds, 5)
    offsets = topk.id_offsets(spark.createDataFrame([(0, 15), (1, 25)], "table int, n long"), ["table"])
    assert got(topk.merge(found.drop("rnk"), offsets, ["table"], 5)) == whole
    by = at.withColumn("cluster", (F.col("id") % 3).cast("int"))
    asked = preds.withColumn("cluster", F.explode(F.array(F.lit(0), F.lit(2))))
    want = {(q, i): sum(a == b for a, b in zip(VECTORS[q], x)) for q in range(5) for i, x in enumerate(VECTORS) if i % 3 != 1}
    assert got(clusters.search_clusters(by, asked, 5)) == ranked(want, 5)


def test_stats(spark):
    at = points.vector_points(from_rows(spark, VECTORS))
    b = {r["dim"]: tuple(r)[1:] for r in stats.bounds(at).collect()}
    for d in range(4):
        col = [x[d] for x in VECTORS]
        assert b[d] == (min(col), max(col), len({*col}), 40)
    p = {(r["dim"], r["value"]): (r["n"], r["first_id"], r["last_id"]) for r in stats.postings(at).collect()}
    ids = [i for i, x in enumerate(VECTORS) if x[0] == VECTORS[0][0]]
    assert p[0, VECTORS[0][0]] == (len(ids), ids[0], ids[-1]) and stats.posting_size(at, 0, VECTORS[0][0]) == len(ids)
    assert stats.contains(at, 0, min(x[0] for x in VECTORS)) and not stats.contains(at, 0, 99)
    d = [r["delta"] for r in stats.deltas(at, 3).where(f"dim = 0 AND value = {VECTORS[0][0]}").orderBy("id").collect()]
    assert d == [b - a for a, b in zip([0, *ids], ids)]
    assert sum(r["n"] * r["n_lists"] for r in stats.list_sizes(at).collect()) == 160


def test_append_csr_and_empty(spark):
    one, two = points.vector_points(from_rows(spark, [[1], [2]])), points.vector_points(from_rows(spark, [[5], [6]])).withColumn("dim", F.lit(1))
    assert sorted(map(tuple, points.append(one, two).collect())) == [(0, 0, 1), (0, 1, 5), (1, 0, 2), (1, 1, 6)]
    assert [r["values"] for r in from_csr(spark, [1, 2, 3], [0, 0, 2]).orderBy("id").collect()] == [[], [1, 2], [3]]
    none = from_rows(spark, VECTORS).limit(0)
    assert engine.search_bags(none, none, 3).count() == 0 == engine.search_sequences(none, none, 3).count()


def test_kmeans_and_query_documents(spark, tmp_path):
    rows = from_rows(spark, [[0, k % 3] for k in range(12)] + [[100, k % 3] for k in range(12)])
    at = clusters.cluster_rows(rows, 2)
    assert sorted(r[0] for r in at.groupBy("cluster").count().select("count").collect()) == [12, 12]
    clusters.save_clusters(at, str(tmp_path / "c"), 2)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 24
    docs = clusters.make_queries(at, 9, 2)
    parsed = clusters.parse_queries(docs)
    assert parsed.count() == 24 and {r["topk"] for r in parsed.collect()} == {9}


#: A table of 20 rows and the known answers of searches for its first three rows in it, as (id, count).
ROWS = [
    [10, 6, 52, 62, 0], [16, 50, 12, 0, 1], [10, 11, 58, 69, 4], [25, 75, 19, 5, 8], [10, 8, 56, 64, 0], [13, 75, 13, 0, 4], [17, 28, 64, 37, 0], [8, 78, 21, 1, 2], [3, 15, 2, 0, 11], [3, 14, 1, 0, 0],
    [54, 1, 0, 16, 8], [20, 13, 53, 50, 0], [28, 86, 16, 1, 4], [13, 102, 22, 1, 0], [18, 3, 20, 40, 18], [97, 18, 9, 9, 0], [35, 30, 2, 3, 27], [36, 27, 3, 0, 1], [11, 8, 2, 3, 6], [42, 21, 4, 5, 4],
]
EXACT = {0: [(0, 5), (4, 2), (2, 1), (6, 1), (9, 1)], 1: [(1, 5), (17, 2), (5, 1), (8, 1), (9, 1)], 2: [(2, 5), (0, 1), (4, 1), (5, 1), (12, 1)]}
WITHIN_1 = {0: [(0, 5), (4, 2), (11, 2), (1, 1), (2, 1)], 1: [(1, 5), (5, 2), (6, 2), (7, 2), (9, 2)], 2: [(2, 5), (0, 1), (4, 1), (5, 1), (12, 1)]}
GROWN = {0: [(0, 5), (4, 5), (2, 3), (11, 3), (18, 2)], 1: [(1, 5), (5, 3), (6, 3), (17, 3), (9, 2)], 2: [(2, 5), (4, 4), (0, 3), (11, 3), (18, 2)]}
GROWN_RANGES = {0: [(9, 11), (3, 9), (46, 58), (50, 69), (0, 0)], 1: [(13, 19), (27, 73), (8, 16), (0, 0), (0, 2)], 2: [(9, 11), (8, 14), (52, 64), (50, 69), (4, 4)]}
AT_OFFSETS = {0: [(0, 0, 5), (4, 0, 2), (2, 0, 1), (6, 0, 1), (9, 0, 1)], 1: [(1, 0, 5), (17, 0, 2), (0, 1, 1), (4, 1, 1), (5, 0, 1)], 2: [(2, 0, 5), (0, 0, 1), (4, 0, 1), (5, 0, 1), (8, 3, 1)]}


def test_known_answers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("".join(",".join(map(str, x)) + ",\n" for x in ROWS))
    path, data = str(tmp_path / "t.csv"), from_rows(spark, ROWS)
    at, first = points.vector_points(data), data.where("id < 3")
    assert got(engine.search(spark, path, path, Config(5, 3))) == EXACT
    assert got(engine.search(spark, path, path, Config(5, 3, 1))) == WITHIN_1
    assert got(engine.search_chunks(at, predicates.radius_predicates(first), 5, 10, exact=True)) == EXACT
    grown = predicates.widen(predicates.radius_predicates(first), at, 0.2)
    found = {}
    for r in grown.orderBy("qid", "dim").collect():
        found.setdefault(r["qid"], []).append((r["lo"], r["up"]))
    assert found == GROWN_RANGES
    assert got(engine.search_adaptive(at, predicates.radius_predicates(first), 5, 0.2)) == GROWN
    assert got(engine.search_subsequences(data, first, 5), "offset") == AT_OFFSETS
    page = topk.top_k(match(at, predicates.radius_predicates(first), exact=True), 2, page=2)
    assert got(page) == {q: x[2:4] for q, x in EXACT.items()}


def test_bag_points_count_within_rows(spark):
    data = from_rows(spark, [*BAGS, [], [4, 4, 4]])
    found = {}
    for r in points.bag_points(data).collect():
        found.setdefault(r["id"], {})[r["value"]] = r["n"]
    assert found == {k: dict(Counter(x)) for k, x in enumerate([*BAGS, [], [4, 4, 4]]) if x}


def test_a_search_in_an_index_reads_what_its_predicates_reach(spark, tmp_path):
    at = points.vector_points(from_rows(spark, VECTORS))
    index.save_index(at, str(tmp_path / "i"))
    preds = predicates.radius_predicates(ask(spark, VECTORS), 1)
    found = engine.search_index(spark, str(tmp_path / "i"), preds, Config(4, 5, 1))
    assert got(found) == got(topk.top_k(match(at, preds), 4))
    assert "PushedFilters: [Or(" in found._jdf.queryExecution().executedPlan().toString().replace("PushedFilters: [IsNotNull(dim), IsNotNull(value), Or(", "PushedFilters: [Or(")
