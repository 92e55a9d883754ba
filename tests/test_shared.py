"""The best rows by shared keys, against counts of all pairs; and that no pairs are made but with the k least ids of a key."""

import random

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import match as M
from tallygrid.operators import points, predicates, shared, topk
from tallygrid.sources.rows import from_rows

@pytest.fixture(autouse=True)
def keys_for_few_predicates(monkeypatch):
    monkeypatch.setattr(shared, "FEW", 0)


NAMES = "qid long, ord int, dim int, lo int, up int, weight double, selectivity double"


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def some(spark, seed, n=120, wide=600):
    """Rows of three dims, of which one has wide ranges, and ranges that overlap, are empty, or repeat."""
    rng = random.Random(seed)
    at = points.vector_points(from_rows(spark, [[rng.randrange(3), rng.randrange(-2 * wide, 2 * wide), rng.randrange(6)] for _ in range(n)]))
    preds = []
    for q in range(9):
        for _ in range(rng.randrange(1, 7)):
            d = rng.randrange(4)
            lo = rng.randrange(-2 * wide, 2 * wide) if d == 1 else rng.randrange(-1, 5)
            preds.append((q, 0, d, lo, lo + (rng.randrange(-2, wide) if d == 1 else rng.randrange(-1, 3)), rng.choice([0.5, 1.0, 2.0]), 0.0))
    return at, spark.createDataFrame(preds, NAMES)


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"weighted": True}), (3, {"cap": 2}), (4, {"descending_ids": True}), (5, {"cap": 1, "weighted": True})])
def test_same_as_all_pairs(spark, seed, how):
    at, preds = some(spark, seed)
    plain = {k: v for k, v in how.items() if k != "descending_ids"}
    kept = topk.top_k(M.match(at, preds, **plain), 4, descending_ids="descending_ids" in how)
    cols = ["qid", "id", "cnt", "rnk"]
    assert shared.grid(at, M.plan(preds, weighted="weighted" in how)) is not None
    assert rows_of(shared.nearest(at, preds, 4, **how), *cols) == rows_of(kept, *cols)


def test_tables_and_clusters_apart(spark):
    at, preds = some(spark, 6)
    at = at.withColumns({"table": F.col("id") % 3, "cluster": F.col("id") % 2})
    preds = preds.withColumn("cluster", F.col("qid") % 2)
    how = {"on": ("cluster",)}
    plain = topk.top_k(M.match(at, preds, **how), 3)
    chunked = shared.nearest(points.chunk(at, 7), preds, 3, chunk=("chunk",), **how)
    assert rows_of(chunked, "qid", "id", "cnt", "rnk") == rows_of(plain, "qid", "id", "cnt", "rnk")
    kept = topk.top_k(M.match(at, preds, keys=("table", "qid", "id"), **how), 3, per=("table", "qid"))
    cols = ["table", "qid", "id", "cnt", "rnk"]
    assert rows_of(shared.nearest(at, preds, 3, per=("table",), **how), *cols) == rows_of(kept, *cols)


def test_where_keys_do_not_apply_all_pairs_are_counted(spark):
    """Rows with two values in a dim, more dims than are looked at, no ranges at all, no rows."""
    at, preds = some(spark, 7)
    cols = ["qid", "id", "cnt", "rnk"]
    twice = at.unionByName(at.where("id % 2 = 0"))
    assert shared.grid(twice, M.plan(preds)) is None
    assert rows_of(shared.nearest(twice, preds, 3), *cols) == rows_of(topk.top_k(M.match(twice, preds), 3), *cols)
    rows = from_rows(spark, [[k % 3] * 8 for k in range(30)])
    many = points.vector_points(rows), predicates.radius_predicates(rows.where("id < 3"))
    assert shared.grid(many[0], M.plan(many[1])) is None
    assert rows_of(shared.nearest(*many, 3), *cols) == rows_of(topk.top_k(M.match(*many), 3), *cols)
    assert shared.nearest(at, preds.limit(0), 3).count() == 0 == shared.nearest(at.limit(0), preds, 3).count()


def test_counts_of_rows(spark):
    at, preds = some(spark, 8)
    one = preds.groupBy("qid", "dim").agg(F.min("lo").alias("lo"), F.max("up").alias("up")).selectExpr("qid", "0 AS ord", "dim", "lo", "up", "1.0D AS weight", "0.0D AS selectivity")
    cols = ["qid", "cnt", "n_rows"]
    for asked in (one, preds):  # ranges that overlap are counted by pairs
        assert rows_of(shared.count_rows(at, asked), *cols) == rows_of(M.match(at, asked).groupBy("qid", "cnt").agg(F.count("*").alias("n_rows")), *cols)
    assert shared.grid(at, M.plan(one)).single


def test_pairs_do_not_grow_with_rows(spark, monkeypatch):
    """All rows match all queries in a dim; what is joined is k rows of each key, whatever the number of rows."""
    sizes = []
    plain = shared.materialize

    def seen(df, label):
        if label == "kept":
            sizes.append(df.count())
        return plain(df, label)

    monkeypatch.setattr(shared, "materialize", seen)
    monkeypatch.setattr(shared, "match", None)  # counting of all pairs
    for n in (400, 1_600):
        at = points.vector_points(from_rows(spark, [[7, k] for k in range(n)]))
        preds = spark.createDataFrame([(q, 0, 0, 7, 7, 1.0, 0.0) for q in range(20)] + [(q, 0, 1, q, q, 1.0, 0.0) for q in range(20)], NAMES)
        assert shared.nearest(at, preds, 3).count() == 60
    assert sizes == [20, 60, 20, 60]


def many_keys(spark):
    """A few rows, and 900 queries with 27 values in each of two dims: files of some kilobytes, and 656,100 keys of both dims."""
    at = points.vector_points(from_rows(spark, [[k % 40, k % 37] for k in range(200)]))
    preds = spark.range(900).selectExpr("id AS qid", "0 AS ord", "explode(array(0, 1)) AS dim", "CAST(id % 9 AS INT) AS lo", "CAST(id % 9 + 26 AS INT) AS up", "1.0D AS weight", "0.0D AS selectivity")
    return at, preds


def plans_of(monkeypatch, label):
    seen, plain = [], shared.materialize

    def noted(df, name):
        if name == label:
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(shared, "materialize", noted)
    return seen


def test_many_keys_of_queries_are_not_broadcast(spark, monkeypatch):
    """They were, as their files are small: by way of the driver, whose memory they filled."""
    at, preds = many_keys(spark)
    plans, cols = plans_of(monkeypatch, "kept"), ["qid", "id", "cnt", "rnk"]
    found = shared.nearest(at, preds, 4)
    assert "SortMergeJoin" in plans[0]
    assert "BroadcastExchange" not in plans[0]
    assert rows_of(found, *cols) == rows_of(topk.top_k(M.match(at, preds), 4), *cols)


def test_many_keys_that_count_rows_are_not_broadcast(spark, monkeypatch):
    at, preds = many_keys(spark)
    plans, cols = plans_of(monkeypatch, "sums"), ["qid", "cnt", "n_rows"]
    found = shared.count_rows(at, preds)
    assert "SortMergeJoin" in plans[1]
    assert "BroadcastExchange" not in plans[1]
    assert rows_of(found, *cols) == rows_of(M.match(at, preds).groupBy("qid", "cnt").agg(F.count("*").alias("n_rows")), *cols)
