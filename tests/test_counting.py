"""Counting where rows lie: plans, segments of ranges, and the best rows without counting all."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallygrid import file_queries
from tallygrid.config import Config
from tallygrid.operators import match as M
from tallygrid.operators import clusters, points, predicates, topk
from tallygrid.plans import engine
from tallygrid.sources import index
from tallygrid.sources.rows import from_rows

NAMES = "qid long, ord int, dim int, lo int, up int, weight double, selectivity double"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("radius", [0, 2, 3_000])
def test_pairs_are_not_shuffled(spark, tmp_path, radius):
    """Points are dealt by id once, or lie by id; counts then need no exchange, and only the best of each task are shuffled."""
    rows = from_rows(spark, [[k * 37 % 9_000, k % 5] for k in range(300)])
    at, preds = points.vector_points(rows), predicates.radius_predicates(rows.where("id < 4"), radius)
    index.save_index(at, str(tmp_path / "i"), 3)
    given = [
        M.match(at, preds, exact=not radius), M.match(points.vector_points(points.dealt(rows)), preds, exact=not radius, by_id=True),
        M.match(index.load_index(spark, str(tmp_path / "i")), preds, exact=not radius, by_id=True),
    ]
    for found, dealt in zip(given, (True, True, False), strict=True):
        assert "hashpartitioning(qid" not in planned(found) and ("hashpartitioning(id" in planned(found)) == dealt
        top = planned(topk.top_k(found, 3))
        assert "WindowGroupLimit" in top and top.count("hashpartitioning(qid") == 1
    assert rows_of(given[0]) == rows_of(given[1]) == rows_of(given[2])


def test_many_predicates_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = from_rows(spark, [[k * 37 % 90, k % 5] for k in range(300)])
    at, preds = points.vector_points(rows), predicates.radius_predicates(rows.where("id < 40"), 2)
    want = rows_of(M.match(at, preds))
    monkeypatch.setattr(M, "BROADCAST_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = M.match(at, preds)
        assert "SortMergeJoin" in planned(found) and rows_of(found) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("seed", range(2))
def test_segments_make_up_their_range(spark, seed):
    rng = random.Random(seed)
    ranges = [(lo, lo + rng.choice([0, 1, 5, 1_000, 10**6, 2**40])) for lo in (rng.randint(-(10**7), 10**7) for _ in range(60))] + [(-1, 0), (-8, 7), (0, 2**61), (-(2**61), -1), (5, 4)]
    df = spark.createDataFrame(ranges, "lo long, up long").where("lo <= up")
    for r in df.select("lo", "up", M.segments(F.col("lo"), F.col("up")).alias("s")).collect():
        parts = sorted((x["node"] << x["level"], (x["node"] + 1) << x["level"]) for x in r["s"])
        assert parts[0][0] == r["lo"] and parts[-1][1] == r["up"] + 1 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert max(sum(x["level"] == y["level"] for x in r["s"]) for y in r["s"]) <= 2


def test_wide_ranges_need_no_filter_behind(spark):
    rng = random.Random(2)
    rows = from_rows(spark, [[rng.randint(-(10**6), 10**6), rng.randint(0, 9)] for _ in range(500)])
    values = [r["values"] for r in rows.orderBy("id").collect()]
    asked = [(q, d, d, lo, lo + w, 1.0, 0.0) for q in range(30) for d, lo, w in ((0, rng.randint(-(10**6), 10**6), rng.choice([0, 900, 1_024, 400_000])), (1, rng.randint(0, 9), rng.choice([0, 2_000])))]
    asked += [(99, 0, 0, -(2**31), 2**31 - 1, 1.0, 0.0)]
    found = M.match(points.vector_points(rows), spark.createDataFrame(asked, NAMES))
    want = {}
    for q, _, d, lo, up, *_ in asked:
        for i, v in enumerate(values):
            want[q, i] = want.get((q, i), 0) + (lo <= v[d] <= up)
    assert rows_of(found) == sorted((q, i, n) for (q, i), n in want.items() if n)
    assert "BroadcastHashJoin" in planned(found) and "BroadcastNestedLoopJoin" not in planned(found) and "SortMergeJoin" not in planned(found)


@pytest.mark.parametrize("seed", range(2))
def test_the_best_without_counting_all(spark, seed, monkeypatch):
    """The same rows as by all counts: with ties at k, weights, caps, several ranges in a dim, and queries without k rows."""
    rng = random.Random(seed)
    monkeypatch.setattr(M, "PROBED", rng.choice([1, 2, 16]))
    spread = [rng.choice([2, 10, 200, 5_000]) for _ in range(4)]
    rows = from_rows(spark, [[rng.randint(0, s) for s in spread] for _ in range(300)])
    asked = []
    for q in range(25):
        for d in rng.sample(range(4), rng.randint(1, 4)):
            for _ in range(rng.choice([1, 1, 2])):
                lo = rng.randint(-2, spread[d])
                asked.append((q, d, d, lo, lo + rng.choice([0, 1, spread[d] // 2, spread[d]]), rng.choice([1.0, 0.5, 3.0]), 0.0))
    asked.append((77, 0, 9, 0, 5, 1.0, 0.0))  # in a dim that isn't there
    preds, at = spark.createDataFrame(asked, NAMES), points.vector_points(rows)
    for k, how in ((5, {}), (5, {"weighted": True}), (3, {"cap": 2}), (400, {})):
        found = M.best(at, preds, k, **how)
        assert rows_of(found.select("qid", "id", "cnt", "rnk")) == rows_of(topk.top_k(M.match(at, preds, **how), k).select("qid", "id", "cnt", "rnk"))
        assert "WindowGroupLimit" in planned(found) and not re.search(r"hashpartitioning\(qid#\d+L?, id#", planned(found))
    assert M.best(at, preds.limit(0), 3).count() == 0 == M.best(at.limit(0), preds, 3).count()


def test_little_is_counted_where_few_ranges_tell(spark, monkeypatch):
    """Half of all rows match in a wide dim; only those of the narrow one are looked at."""
    rows = from_rows(spark, [[k % 400, k % 10_000] for k in range(40_000)])
    preds = predicates.radius_predicates(rows.where("id IN (3, 5)")).withColumn("up", F.col("up") + F.when(F.col("dim") == 1, 5_000).otherwise(0))
    at, real, seen = points.vector_points(rows), M.met, []
    monkeypatch.setattr(M, "met", lambda *a, **b: seen.append(real(*a, **b)) or seen[-1])
    assert rows_of(M.best(at, preds, 10)) == rows_of(topk.top_k(M.match(at, preds), 10))
    *few, whole = [df.count() for df in seen]
    assert sum(few) < 500 and whole > 40_000


def test_added_segments(spark, tmp_path):
    """Searches in an index that grew, was merged, and lost an attempt that failed on the way."""
    path = str(tmp_path / "i")
    vectors = [[(k * 7) % 50 + (1_000 if k >= 200 else 0), k % 9] for k in range(260)]
    at = points.vector_points(from_rows(spark, vectors))
    index.save_index(at.where("id < 20"), path, 2)
    for lo, up in ((20, 40), (40, 60), (60, 80), (80, 100), (100, 200), (200, 260)):
        index.append_index(at.where(f"id >= {lo} AND id < {up}"), path)
    each = index.segments(spark, path)
    assert sum(p.count() for p, _ in each) == at.count() and 1 < len(each) < 7
    index._segment(at, path, index._state(spark, path))  # written, but never noted
    preds = predicates.radius_predicates(from_rows(spark, vectors).where("id % 20 = 0"), 1)
    for config in (Config(4, 5, 1), Config(4, 5), Config(4, 5, 1, pad=True)):
        found = engine.search_index(spark, path, preds, config)
        assert rows_of(found.select("qid", "id", "cnt", "rnk")) == rows_of(engine.match_queries(at, preds, config).select("qid", "id", "cnt", "rnk"))
    assert rows_of(index.load_bounds(spark, path)) == rows_of(index.bounds(at))
    far = predicates.radius_predicates(from_rows(spark, [[1_020, 99]]), 1)
    assert sum(index.reached(b, far) for _, b in each) == 1
    index.save_index(at.where("id < 10"), path, 3)
    assert len(index.segments(spark, path)) == 1 and index.load_index(spark, path).count() == 20
    with pytest.raises(ValueError):
        index.append_index(at, str(tmp_path / "none"))


def test_islands_part_ranges_at_the_largest_gaps(spark):
    asked = [(1, 0, 0, lo, lo + 2, 1.0, 0.0) for lo in (0, 2, 10, 12, 500, 503, 9_000)] + [(1, 0, 1, 5, 4, 1.0, 0.0), (2, 0, 1, 0, 100, 1.0, 0.0), (2, 0, 1, 7, 9, 1.0, 0.0)]
    preds = spark.createDataFrame(asked, NAMES)
    assert rows_of(index.islands(preds)) == [(0, 0, 4), (0, 10, 14), (0, 500, 505), (0, 9_000, 9_002), (1, 0, 100)]
    assert rows_of(index.islands(preds, 2)) == [(0, 0, 505), (0, 9_000, 9_002), (1, 0, 100)]


def test_what_is_read_follows_the_ranges(spark, tmp_path):
    """Pages of a bucket without a value of a range are left out of the scan."""
    at = points.column_points(spark.range(0, 200_000, 1, 2), "id", {"a": F.col("id") * 7919 % 100_003, "b": F.col("id") % 11})
    index.save_index(at, str(tmp_path / "i"), 2)
    [(stored, _)] = index.segments(spark, str(tmp_path / "i"))

    def read(n):
        """Rows that the scan of n scattered ranges gives to what follows, and those that match."""
        preds = spark.createDataFrame([(q, 0, 0, q * 100_000 // n, q * 100_000 // n + 20, 1.0, 0.0) for q in range(n)], NAMES)
        df = stored.where(index.reach(preds))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().head()
        return plan.metrics().apply("numOutputRows").value()

    few, more = read(1), read(8)
    assert few <= 2 * 2 * index.PAGE_ROWS and few < more <= 8 * 2 * 2 * index.PAGE_ROWS < 400_000


def test_clusters_that_are_not_asked_are_not_read(spark, tmp_path):
    rows = from_rows(spark, [[k % 50, k % 7] for k in range(500)]).withColumn("cluster", (F.col("id") % 10).cast("int"))
    at = points.vector_points(rows).join(rows.select("id", "cluster"), "id")
    index.save_index(at, str(tmp_path / "i"), 2, by=("cluster",))
    stored = index.load_index(spark, str(tmp_path / "i"))
    assert len(list((tmp_path / "i").glob("segment-*/points/cluster=*"))) == 10
    asked = predicates.as_predicates(points.vector_points(rows.where("id IN (3, 13, 4)"))).join(rows.select(F.col("id").alias("qid"), "cluster"), "qid")
    for radius in (0, 1):
        preds = asked.withColumn("lo", F.col("lo") - radius).withColumn("up", F.col("up") + radius)
        found = clusters.search_clusters(stored, preds, 4, exact=not radius, by_id=True)
        assert "dynamicpruning" in planned(found).lower() and "hashpartitioning(id" not in planned(found)
        assert rows_of(found) == rows_of(clusters.search_clusters(at, preds, 4, exact=not radius))
        found.collect()
        scans = re.findall(r"dynamicpruning\w*", planned(found))
        assert scans


def test_many_queries_are_asked_in_blocks_whatever_lists_are_long(spark, monkeypatch):
    """A token in a third of all bags: points stay where they were dealt, and no task gets the list."""
    rng = random.Random(8)
    bags = [[0] * (k % 3 == 0) + [rng.randint(1, 400) for _ in range(6)] for k in range(600)]
    rows = from_rows(spark, bags)
    want = rows_of(engine.search_bags(rows, rows.where("id < 200"), 5))
    monkeypatch.setattr(M, "BROADCAST_ROWS", 200)
    found = engine.search_bags(rows, rows.where("id < 200"), 5)
    plan = planned(found)
    assert plan.count("BroadcastHashJoin") > 8 and "SortMergeJoin" not in plan and not re.search(r"hashpartitioning\((dim|value)", plan)
    assert rows_of(found) == want
    sizes = [len(x) for x in points.bag_points(points.dealt(rows)).rdd.glom().collect()]
    assert max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("seed", range(2))
def test_growth_by_passes_over_sorted_values(spark, monkeypatch, seed):
    """As by arrays that every task has: with gaps, values below 0, ranges beyond all values, dims that aren't there, own shares."""
    rng = random.Random(seed)
    values = [[rng.choice([rng.randint(-20, 60), rng.randint(0, 9) * 10_000 + rng.randint(0, 5)]), rng.randint(5, 9), -rng.randint(1, 30)] for _ in range(200)]
    at = points.vector_points(from_rows(spark, values))
    asked = [(q, k, rng.randint(0, 3), lo, lo + rng.choice([0, 0, 3, 500]), 1.0, rng.choice([0.0, 0.0, 0.01, 0.9])) for q in range(20) for k, lo in enumerate([rng.randint(-40, 70), rng.choice([95_000, 120_000, -100, 0, 7]), rng.randint(0, 100_000)])]
    preds = spark.createDataFrame(asked, NAMES)
    want = rows_of(predicates.widen(preds, at, 0.3))
    monkeypatch.setattr(predicates, "HISTOGRAM_ROWS", 1)
    monkeypatch.setattr(predicates, "PROBES", rng.choice([3, 64]))
    found = predicates.widen(preds, at, 0.3)
    assert rows_of(found) == want and found.dtypes == preds.dtypes
    assert "Python" not in planned(found) and "Pandas" not in planned(found)
    assert predicates.widen(preds.limit(0), at, 0.3).count() == 0


def test_values_of_one_dim_are_dealt_over_tasks(spark, monkeypatch):
    from tallygrid.operators import stats

    seen, real = [], stats.materialize
    monkeypatch.setattr(stats, "materialize", lambda df, label: seen.append(real(df, label)) or seen[-1])
    at = points.column_points(spark.range(100_000), "id", {"a": F.col("id") * 7})
    monkeypatch.setattr(predicates, "HISTOGRAM_ROWS", 1_000)
    preds = spark.createDataFrame([(1, 0, 0, 70_000, 70_000, 1.0, 0.0)], NAMES)
    [r] = predicates.widen(preds, at, 0.01).collect()
    assert (r["lo"], r["up"]) == (70_000 - 3_500, 70_000 + 3_500)
    sizes = [r["count"] for r in seen[0].groupBy("__range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_matches_are_made_in_many_tasks(spark, monkeypatch):
    """All pairs were made in the one task that read the points; blocks of queries give the same."""
    rows = from_rows(spark, [[k * 37 % 90, k % 5] for k in range(300)]).coalesce(1)
    at, preds = points.vector_points(rows), predicates.radius_predicates(rows.where("id < 40"), 2)
    found = M.match_positions(at, preds)
    want = sorted((q, k, d, v) for q in range(40) for k in range(300) for d, (v, w) in enumerate(zip((k * 37 % 90, k % 5), (q * 37 % 90, q % 5), strict=True)) if abs(v - w) <= 2)
    assert rows_of(found) == want and rows_of(found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.count("*") >= 3, F.max("n") < len(want) // 2)) == [(True, True)]
    dealt = M.match_positions(points.vector_points(points.dealt(rows)), preds, by_id=True)
    assert planned(dealt).count("hashpartitioning(id") == 1 and rows_of(dealt) == want
    monkeypatch.setattr(M, "BROADCAST_ROWS", 100)
    blocks = M.match_positions(at, preds)
    assert rows_of(blocks) == want and "SortMergeJoin" not in planned(blocks)


def test_all_pairs_are_made_once(spark, monkeypatch):
    """Each pair was made once for each dim in which it matches, and summed up; what doesn't fit is counted as before."""
    rng = random.Random(5)
    rows = from_rows(spark, [[rng.choice([None, *range(12)]), rng.randrange(40), rng.choice([None, 0, 1, 2])] for _ in range(200)])
    at = points.vector_points(rows).where("value IS NOT NULL")
    preds = predicates.radius_predicates(rows.where("id < 40"), 1).where("lo IS NOT NULL AND (qid % 7 <> 0 OR dim = 1)")
    preds = preds.withColumn("lo", F.when((F.col("qid") == 5) & (F.col("dim") == 0), F.col("up") + 1).otherwise(F.col("lo")))
    twice = preds.unionByName(preds.where("qid % 3 = 0"))
    for asked in (preds, twice, preds.where("dim = 2"), preds.where("qid < 0")):
        assert rows_of(M.all_pairs(at, asked)) == rows_of(M.match(at, asked))
    found = M.all_pairs(points.vector_points(points.dealt(rows)).where("value IS NOT NULL"), preds, by_id=True)
    plan = planned(found)
    assert "hashpartitioning(qid" not in plan and not re.search(r"HashAggregate\(keys=\[qid", plan) and plan.count("BroadcastHashJoin") == 3
    want = rows_of(M.match(at, preds))
    assert rows_of(found) == want
    monkeypatch.setattr(M, "BROADCAST_ROWS", 70)
    blocks = M.all_pairs(at, preds)
    assert planned(blocks).count("BroadcastHashJoin") > 3 and rows_of(blocks) == want
    monkeypatch.undo()
    wide = preds.withColumn("up", F.when(F.col("dim") == 1, F.col("lo") + 5_000).otherwise(F.col("up")))
    several = preds.unionByName(preds.where("dim = 1").withColumn("lo", F.col("lo") - 4))
    for p, q in ((at, wide), (at, several), (at.unionByName(at.where("id < 9")), preds)):
        assert rows_of(M.all_pairs(p, q)) == rows_of(M.match(p, q))


def test_all_counts_sums_no_pairs_up(spark):
    """The registered query, whose plan summed up a pair's matches in a hash table of all pairs of a task."""
    plan = planned(file_queries.all_counts(spark, "/root/testdata/sf0.001"))
    assert not re.search(r"HashAggregate\(keys=\[qid", plan) and "hashpartitioning(qid" not in plan


def test_many_predicates_are_not_broadcast(spark, monkeypatch):
    """Dealt out to their values they are many, and come from small files, by which Spark would have broadcast them."""
    monkeypatch.setattr(M, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(M, "BLOCKS", 0)
    at = points.vector_points(from_rows(spark, [[k % 7] for k in range(50)]))
    for up in (5, 3_000):  # by values, and by segments
        preds = spark.range(20).selectExpr("id AS qid", "0 AS ord", "0 AS dim", "CAST(id % 3 AS INT) AS lo", f"CAST(id % 3 + {up} AS INT) AS up", "1.0D AS weight", "0.0D AS selectivity")
        counts = M.match(at, preds)
        assert "BroadcastExchange" not in counts._jdf.queryExecution().executedPlan().toString()
        assert counts.count() == sum(q % 3 <= k % 7 <= q % 3 + up for q in range(20) for k in range(50))
