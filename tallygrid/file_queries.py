"""Registered queries of what surrounds a search: text files, indexes, query documents, builders, the service.

Text that a query reads it writes itself, from whole tables, into the shared folder.
"""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli, metrics
from .config import Config, OnlineConfig
from .functions import arrays
from .operators import clusters, points, predicates, stats
from .operators.match import all_pairs, match, match_positions
from .operators.shared import count_rows, nearest
from .plans import engine, policy
from .queries import GROWN, K, ORDER_POINTS, PART_POINTS, SEQUENCES, WORDS, Query, _asked, _orders, _out, _parts, _self, _sequences, _sql, _table
from .sources import index, rows
from .streaming import online
from .workspace import workspace


def _written(df: DataFrame, line: Column, order: str, label: str) -> str:
    """Text files with a line for each row: sorted by ranges, a file each, so that files and their lines are in order."""
    path = workspace(df.sparkSession, label) + ".csv"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.select(order, line.alias("line")).repartitionByRange(n, order).sortWithinPartitions(order).select("line").write.text(path)
    return path


def _part_lines(spark: SparkSession, sf_dir: str) -> str:
    """Values of part with mixed delimiters, one that is no number, and a trailing comma."""
    price = F.floor("p_retailprice").cast("string")
    return _written(_table(spark, sf_dir, "part"), F.concat(F.col("p_size"), F.lit(", "), price, F.lit(" "), F.col("p_partkey") % 31, F.lit(" x,")), "p_partkey", "rows")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as rows (id, values) of size, price and key modulo 31."""
    at = _table(spark, sf_dir, "part")
    return at.select(F.col("p_partkey").alias("id"), F.array("p_size", F.floor("p_retailprice").cast("int"), (F.col("p_partkey") % 31).cast("int")).alias("values"))


def _joined(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.array_join(F.col("values").cast("array<string>"), ",").alias("vals"))


def rows_from_text(spark, sf_dir):
    return _joined(rows.read_rows(spark, _part_lines(spark, sf_dir)), "id")


def rows_first(spark, sf_dir):
    """The first 150 lines, as queries are taken from a file."""
    return _joined(rows.read_rows(spark, _part_lines(spark, sf_dir), 150), "id")


def rows_converted(spark, sf_dir):
    """Fields become their lengths instead of numbers."""
    return _joined(rows.read_rows(spark, _part_lines(spark, sf_dir), convert=F.length), "id")


def _long_form(spark: SparkSession, sf_dir: str) -> str:
    """qid, dim, value, selectivity, weight of every hundredth part, in two dims; every third line lacks a field."""
    at = _table(spark, sf_dir, "part").where("p_partkey % 100 = 0")
    two = F.array(F.struct(F.lit(0).alias("dim"), F.col("p_size").alias("v"), F.lit("0.1").alias("s")), F.struct(F.lit(2).alias("dim"), (F.col("p_partkey") % 31).cast("int").alias("v"), F.lit("0.25").alias("s")))
    at = at.select("p_partkey", F.explode(two).alias("x")).withColumn("key", F.col("p_partkey") * 2 + F.col("x.dim") / 2)
    last = F.when(F.col("key") % 3 > 0, F.lit(" 1.5"))
    return _written(at, F.concat_ws("", F.concat_ws(" ", "p_partkey", "x.dim", "x.v", "x.s"), last), "key", "long-form")


def predicates_long_form(spark, sf_dir):
    at = rows.read_predicates(spark, _long_form(spark, sf_dir))
    return at.select("qid", "dim", "value", F.col("selectivity").cast("double").alias("selectivity"), F.col("weight").cast("double").alias("weight"))


def multirange_from_text(spark, sf_dir):
    """Each range grows to its own share of all rows; all queries are taken."""
    at = rows.read_predicates(spark, _long_form(spark, sf_dir))
    n = _table(spark, sf_dir, "part").count()
    return predicates.multirange(at, _parts(spark, sf_dir), n, n).select("qid", "dim", "lo", "up")


def radius_queries_from_text(spark, sf_dir):
    """The lower ends of ranges are 0 at least; only two places are asked."""
    at = rows.read_radius_queries(spark, _part_lines(spark, sf_dir), 20, dims=2)
    return at.select("qid", "dim", "lo", "up")


def _cluster_files(df: DataFrame, cluster: Column, shard: Column, line: Column, order: str, label: str) -> str:
    """Text of rows in a folder x_CLUSTER_SHARD.csv each, by their order; the pattern that names them."""
    folder = workspace(df.sparkSession, label)
    at = df.select(F.format_string("x_%d_%d.csv", cluster, shard).alias("file"), F.col(order).alias("place"), line.alias("line"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = at.repartitionByRange(n, "file", "place").sortWithinPartitions("file", "place")  # a file may be parted, in its order
    at.select("file", "line").write.partitionBy("file").text(folder)
    return f"{folder}/file=x_*_*.csv"


def clusters_from_files(spark, sf_dir):
    """A file for each nation and parity of customers; ids count within it."""
    at = _table(spark, sf_dir, "customer")
    line = F.concat(F.col("c_custkey"), F.lit(","), F.floor("c_acctbal").cast("string"))
    return _joined(rows.read_clusters(spark, _cluster_files(at, F.col("c_nationkey"), F.col("c_custkey") % 2, line, "c_custkey", "clusters")), "cluster", "shard", "id")


def rows_in_memory(spark, sf_dir):
    """As lists, and as flat data with the places where rows start."""
    at = [[r[0], r[1]] for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").collect()]  # 25 rows at any size
    flat = rows.from_csr(spark, [v for x in at for v in x], [*range(0, 2 * len(at), 2)])
    return _joined(rows.from_rows(spark, at).withColumn("flat", F.lit(False)).unionByName(flat.withColumn("flat", F.lit(True))), "id", "flat")


def rows_from_flat(spark, sf_dir):
    """The values of all parts in one flat table, and where each begins."""
    at = _vectors(spark, sf_dir)
    flat = at.select("id", F.posexplode("values").alias("k", "value")).select((F.col("id") * 3 + F.col("k")).alias("place"), "value")
    return _joined(rows.from_flat(flat, at.select((F.col("id") * 3).alias("start"))), "id")


def search_files(spark, sf_dir):
    """From text to results; the first 100 lines are asked."""
    path = _part_lines(spark, sf_dir)
    return _out(engine.search(spark, path, path, Config(K, 100, 2)))


def search_in_index(spark, sf_dir):
    """Saved, loaded and searched; the scan is filtered by what the queries reach."""
    at = _orders(spark, sf_dir)
    index.save_index(at, path := workspace(spark, "index"))
    return _out(engine.search_index(spark, path, _asked(at, 1), Config(K, 1, 1)))


def index_from_text(spark, sf_dir):
    """By the shell's command; its posting lists."""
    cli.main(["index", "-i", _part_lines(spark, sf_dir), "-o", path := workspace(spark, "index")], spark)
    return stats.postings(index.load_index(spark, path))


def stored_bounds(spark, sf_dir):
    index.save_index(_parts(spark, sf_dir), path := workspace(spark, "index"))
    return index.load_bounds(spark, path)


def results_as_text(spark, sf_dir):
    """Saved as lines of id and count, and read again."""
    at = _parts(spark, sf_dir)
    index.save_results(nearest(at, _asked(at), K, exact=True), path := workspace(spark, "results"))
    return _joined(rows.read_rows(spark, path), "id")


def all_counts(spark, sf_dir):
    """Before the best are chosen."""
    return all_pairs(_parts(spark, sf_dir, by_id=True), _asked(_parts(spark, sf_dir), 1), by_id=True)


def all_matches(spark, sf_dir):
    return match_positions(_parts(spark, sf_dir, by_id=True), _asked(_parts(spark, sf_dir)), by_id=True)


def _wide(at: DataFrame) -> DataFrame:
    width = F.when(F.col("dim") == 0, 3_000).otherwise(5)
    return _asked(at).where("dim IN (0, 2)").withColumn("lo", F.col("lo") - width).withColumn("up", F.col("up") + width)


def wide_ranges(spark, sf_dir):
    """Of over 1,024 values, which go by cells: five days and 3,000 customers either way."""
    at = _orders(spark, sf_dir)
    return _out(nearest(at, _wide(at), K))


def all_wide_counts(spark, sf_dir):
    """The same ranges, counted in full: how many rows match in one dim, and in both."""
    at = _orders(spark, sf_dir)
    return count_rows(at, _wide(at))


def single_range_search(spark, sf_dir):
    """By settings, from rows."""
    at = _vectors(spark, sf_dir)
    config = Config(K, 1, 1)
    return _out(engine.match_queries(engine.build_index(at), engine.build_queries(at.where("id % 100 = 0"), config), config))


class Parity(policy.Policy):
    """An encoding of one's own: values count by whether they are even, and prices by the hundred."""

    def points(self, rows: DataFrame) -> DataFrame:
        at = super().points(rows)
        return at.withColumn("value", F.when(F.col("dim") == 1, F.floor(F.col("value") / 100)).otherwise(F.col("value") % 2).cast("int"))

    def predicates(self, rows: DataFrame) -> DataFrame:
        return predicates.as_predicates(self.points(rows))


def policy_search(spark, sf_dir):
    at, own = _vectors(spark, sf_dir), Parity(Config(K, 1))
    return _out(own.match(own.points(at), own.predicates(at.where("id % 100 = 0"))))


def policy_from_files(spark, sf_dir):
    """By settings from a file; the first 100 lines are asked."""
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:  # read by the driver alone
        f.write('{"k": 10, "num_of_queries": 100, "query_range": 3}')
        f.flush()
        chosen = policy.make_policy(Config.from_file(f.name))
    path = _part_lines(spark, sf_dir)
    return _out(policy.search(spark, chosen, path, path))


def tables_as_lines(spark, sf_dir):
    return metrics.dump_table(_parts(spark, sf_dir))


def results_as_lines(spark, sf_dir):
    at = _parts(spark, sf_dir)
    return metrics.dump_results(nearest(at, _asked(at), K, exact=True))


def lists_as_lines(spark, sf_dir):
    """Posting lists, 1,024 ids a line at most."""
    return metrics.dump_lists(_parts(spark, sf_dir))


def grounded_sequences(spark, sf_dir):
    """Sequences less the least of all values."""
    at = _sequences(spark, sf_dir)
    least = points.value_bounds(at).select("least")
    return _joined(at.join(F.broadcast(least)).select("id", arrays.ground(F.col("values"), F.col("least")).alias("values")), "id")  # one row


def appended_dims(spark, sf_dir):
    """A table's dims with those of another, of the same rows."""
    at = _table(spark, sf_dir, "part")
    more = points.column_points(at, "p_partkey", {"brand": arrays.to_int(F.regexp_extract("p_brand", "[0-9]+", 0))}).withColumn("dim", F.col("dim") + 3)
    both = points.append(_parts(spark, sf_dir), more)
    return _out(nearest(both, _asked(both), K, exact=True))


def chunk_sizes(spark, sf_dir):
    return points.chunk(_parts(spark, sf_dir), 700).groupBy("chunk").agg(F.count("*").alias("n_points"), F.countDistinct("id").alias("n_rows"))


def clamped_predicates(spark, sf_dir):
    """Cut to the bounds of the dims; those outside are dropped."""
    at = _parts(spark, sf_dir)
    far = _asked(at, 30).withColumn("lo", F.col("lo") + F.when(F.col("qid") % 300 == 0, 2_000).otherwise(0)).withColumn("up", F.col("up") + F.when(F.col("qid") % 300 == 0, 2_000).otherwise(0))
    return predicates.clamp(far, stats.bounds(at)).select("qid", "dim", "lo", "up")


def ranges_counted(spark, sf_dir):
    """Of queries in three dims, of which one is cleared for all and one for a query."""
    preds = _asked(_parts(spark, sf_dir))
    return predicates.count_ranges(predicates.clear_dim(predicates.clear_dim(preds.unionByName(preds), 2), 1, 200))


def ranges_as_lines(spark, sf_dir):
    return predicates.dump(_asked(_parts(spark, sf_dir), 2))


def points_covered(spark, sf_dir):
    at = _parts(spark, sf_dir)
    return predicates.selectivity_of(_asked(at, 4), at).select("qid", "dim", "covered")


def k_by_query(spark, sf_dir):
    at = _parts(spark, sf_dir)
    return _out(nearest(at, _asked(at), 7, exact=True).where(F.col("rnk") <= (F.col("qid") / 100 % 7 + 1).cast("int")))


def first_of_the_queries(spark, sf_dir):
    """The predicates of the first 12 queries."""
    return predicates.first_queries(_asked(_parts(spark, sf_dir)), 12).select("qid", "dim", "lo")


def several_tables(spark, sf_dir):
    """One search over three tables, each with its own results."""
    at = _parts(spark, sf_dir)
    found = engine.search_tables([at.where(F.col("id") % 3 == k) for k in range(3)], _asked(at), K, exact=True)
    return found.select("table", "qid", "id", "cnt", F.col("rnk").cast("long").alias("rnk"))


def lists_analyzed(spark, sf_dir):
    """Each posting list's size, plain and under a codec."""
    return metrics.analyze(_parts(spark, sf_dir), "heavy")


def packed_ids(spark, sf_dir):
    """Places in sequences, packed with their row and taken apart again."""
    at = points.position_points(_sequences(spark, sf_dir)).withColumn("packed", arrays.pack_id(F.col("id"), F.col("pos"), 12))
    row, place = arrays.unpack_id(F.col("packed"), 12)
    return at.select("packed", row.alias("row"), place.alias("place"), "value")


def prefix_sums(spark, sf_dir):
    """Of the sizes of all parts before."""
    return stats.prefix_sums(_table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("n")), ["p_partkey"], "n")


def fields_as_integers(spark, sf_dir):
    """The integer with which a text begins, else 0."""
    return _table(spark, sf_dir, "customer").select("c_custkey", arrays.to_int(F.substring("c_name", 8, 20)).alias("tail"), arrays.to_int(F.concat(F.lit(" -"), F.col("c_nationkey"), F.lit("z"))).alias("signed"), arrays.to_int("c_mktsegment").alias("none"))


def sequence_bounds(spark, sf_dir):
    return points.value_bounds(_sequences(spark, sf_dir))


def _answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """part in clusters by size modulo 5, and documents that ask for every hundredth in its own cluster."""
    at = _vectors(spark, sf_dir).withColumn("cluster", F.col("values")[0] % 5)
    return at, clusters.make_queries(at.where("id % 100 = 0"), 3, 5)


def query_documents(spark, sf_dir):
    """Made for each cluster and taken apart: what is asked of which."""
    asked = clusters.routed(clusters.parse_queries(_answered(spark, sf_dir)[1]))
    return asked.select("topk", "cluster", F.array_join(F.col("content").cast("array<string>"), ",").alias("vals"))


def _by_answer(found: DataFrame) -> DataFrame:
    return found.groupBy("id", "cnt", F.col("rnk").cast("long").alias("rnk")).agg(F.count("*").alias("answers"))


def service_batch(spark, sf_dir):
    """Documents in files, a line each, answered by the service until none is left. Results by what was asked."""
    at, documents = _answered(spark, sf_dir)
    base = workspace(spark, "service")
    documents.write.text(f"{base}/in")
    table = points.vector_points(at).join(at.select("id", "cluster"), "id")
    online.serve(spark, table, f"{base}/in", f"{base}/out", f"{base}/state", once=True, lines=True).awaitTermination()
    return _by_answer(spark.read.parquet(f"{base}/out"))


def service_by_settings(spark, sf_dir):
    """The service of a settings file: clusters are read from files, of which the last isn't taken, and ids count on from file to
    file; a query's values may be off by one."""
    at = _vectors(spark, sf_dir).withColumn("cluster", F.col("values")[0] % 6).withColumn("line", F.array_join(F.col("values").cast("array<string>"), ","))
    files = _cluster_files(at, F.col("cluster"), F.lit(0), F.col("line"), "id", "service-files")
    base = workspace(spark, "service")
    clusters.make_queries(at.where("id % 100 = 0"), 3, 6).write.text(f"{base}/in")
    settings = {"data_file": files.removesuffix("_*_*.csv"), "dim": 3, "count_threshold": 3, "data_type": 0, "search_type": 0, "max_data_size": 0, "num_of_cluster": 5, "data_format": 0, "radius": 1, "selectivity": 0.0}
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:  # read by the driver alone
        json.dump(settings, f)
        f.flush()
        config = OnlineConfig.from_file(f.name)
    online.serve_configured(spark, config, f"{base}/in", f"{base}/out", f"{base}/state", once=True, lines=True).awaitTermination()
    return _by_answer(spark.read.parquet(f"{base}/out"))


def clusters_by_kmeans(spark, sf_dir):
    """Each cluster that k-means made, and that its rows have no other mean nearer to them. (Which clusters it makes, SQL can't tell.)"""
    at = _vectors(spark, sf_dir)
    made = clusters.cluster_rows(at, 5).select("id", "cluster", F.col("values").cast("array<double>").alias("v"))
    means = made.groupBy("cluster").agg(*(F.avg(F.get("v", F.lit(k))).alias(f"m{k}") for k in range(3))).collect()  # five rows
    apart = lambda r: sum((F.get("v", F.lit(k)) - F.lit(r[f"m{k}"])) ** 2 for k in range(3))
    near = made.select(F.col("cluster").alias("own"), F.array_min(F.array(*(F.struct(apart(r).alias("d"), F.lit(r["cluster"]).alias("c")) for r in means)))["c"].alias("nearest"))
    # Means of the last step may have moved past a row at the edge: those few are counted as well.
    return near.agg(F.count("*").alias("n"), F.countDistinct("own").alias("clusters"), (F.count_if(F.col("own") == F.col("nearest")) >= 0.99 * F.count("*")).alias("nearly_all"))


def clusters_split(spark, sf_dir):
    """Rows saved by cluster and shard, read again: each once, in its cluster, in a shard that its id tells."""
    at = _vectors(spark, sf_dir).withColumn("cluster", F.col("values")[0] % 5)
    clusters.save_clusters(at, path := workspace(spark, "split"), 3)
    back = spark.read.parquet(path)
    own = F.pmod(F.xxhash64("id"), F.lit(3)).cast("int") == F.col("shard")
    return back.groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum("id").alias("sum_of_ids"), F.bool_and(own).alias("own_shard"), F.countDistinct("shard").alias("shards"))


def figures_of_a_search(spark, sf_dir):
    """Of the figures that are kept of a search, those that aren't times: written as CSV and read again."""
    at, config = _parts(spark, sf_dir), Config(K, 1, 1)
    figures = metrics.search_figures(at, _asked(at, 1), config)
    with tempfile.NamedTemporaryFile("r", suffix=".csv") as f:  # a line, on the driver
        metrics.write_csv([figures], metrics.SEARCH_COLUMNS, f.name)
        head, line = f.read().splitlines()
    told = dict(zip(head.split(","), line.split(","), strict=True))
    return spark.range(1).select(F.lit(told["codec"]).alias("codec"), *(F.lit(int(told[c])).cast("long").alias(c) for c in ("invSize", "dimsSize", "topksSize")))


LINES = "(SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS id, CAST(p_size AS INT) AS s, CAST(floor(p_retailprice) AS INT) AS p, CAST(p_partkey % 31 AS INT) AS k FROM part)"
LONG = """a AS (SELECT p_partkey AS qid, 0 AS dim, CAST(p_size AS INT) AS value, CAST(0.1 AS FLOAT) AS s, p_partkey * 2 AS key FROM part WHERE p_partkey % 100 = 0
  UNION ALL SELECT p_partkey, 2, CAST(p_partkey % 31 AS INT), CAST(0.25 AS FLOAT), p_partkey * 2 + 1 FROM part WHERE p_partkey % 100 = 0),
lf AS (SELECT CAST(qid AS INT) AS qid, dim, value, s FROM a WHERE key % 3 > 0)"""
#: GROWN, with a share for each range.
OWN_SHARE = (
    GROWN.replace("need AS (SELECT CAST(ceil(0.2 * count(DISTINCT id)) AS BIGINT) AS need FROM pts),\n", "")
    .replace("SELECT id AS qid, dim, value AS lo, value AS up FROM pts WHERE id % 100 = 0", "SELECT qid, dim, value AS lo, value AS up, (SELECT CAST(ceil(CAST(CAST(s AS FLOAT) AS DOUBLE) * count(*)) AS BIGINT) FROM part) AS need FROM lf")
    .replace("THEN up ELSE up + 1 END\n", "THEN up ELSE up + 1 END, need\n").replace("JOIN bd USING (dim), need", "JOIN bd USING (dim)")
)
FILE_POINTS = f"o AS (SELECT id, [s, p, k, 0] AS v FROM {LINES}), pts AS (SELECT id, unnest(range(4)) AS dim, unnest(v) AS value FROM o)"
APPENDED = f"{PART_POINTS.replace('pts AS (', 'three AS (')}, pts AS (SELECT * FROM three UNION ALL SELECT p_partkey, 3, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) FROM part)"
PARITY = f"{PART_POINTS.replace('pts AS (', 'three AS (')}, pts AS (SELECT id, dim, CASE dim WHEN 1 THEN value // 100 ELSE value % 2 END AS value FROM three)"
ONE = "SELECT id AS qid, dim, value AS lo, value AS up FROM pts WHERE id % 100 = 0"
TOP = "row_number() OVER (PARTITION BY {} ORDER BY cnt DESC, id) AS rnk"


def oracle_sql() -> dict[str, str]:
    """For each query."""
    part = f"WITH {PART_POINTS}"
    service = f"""{part}, q AS (SELECT DISTINCT v, v[1] % 5 AS c FROM o WHERE id % 100 = 0),
      n AS (SELECT v, count(*) AS times FROM o WHERE id % 100 = 0 GROUP BY v),
      cnts AS (SELECT q.v, o.id, CAST(o.v[1] = q.v[1] AS BIGINT) + CAST(o.v[2] = q.v[2] AS BIGINT) + CAST(o.v[3] = q.v[3] AS BIGINT) AS cnt FROM q JOIN o ON o.v[1] % 5 = q.c),
      top AS (SELECT v, id, cnt, {TOP.format("v")} FROM cnts WHERE cnt > 0)
      SELECT id, cnt, rnk, CAST(sum(times) AS BIGINT) AS answers FROM top JOIN n USING (v) WHERE rnk <= 3 GROUP BY id, cnt, rnk"""
    return {
        "rows_from_text": f"SELECT id, concat_ws(',', s, p, k, 0) AS vals FROM {LINES}",
        "rows_first": f"SELECT id, concat_ws(',', s, p, k, 0) AS vals FROM {LINES} WHERE id < 150",
        "rows_converted": f"SELECT id, concat_ws(',', length(CAST(s AS VARCHAR)), length(CAST(p AS VARCHAR)), length(CAST(k AS VARCHAR)), 1) AS vals FROM {LINES}",
        "predicates_long_form": f"WITH {LONG} SELECT qid, dim, value, CAST(CAST(s AS FLOAT) AS DOUBLE) AS selectivity, CAST(1.5 AS DOUBLE) AS weight FROM lf",
        "multirange_from_text": f"WITH RECURSIVE {PART_POINTS}, {LONG}, {OWN_SHARE} SELECT * FROM wide",
        "radius_queries_from_text": f"SELECT id AS qid, dim, greatest(v - 20, 0) AS lo, v + 20 AS up FROM (SELECT id, 0 AS dim, s AS v FROM {LINES} UNION ALL SELECT id, 1, p FROM {LINES})",
        "clusters_from_files": "SELECT c_nationkey AS cluster, CAST(c_custkey % 2 AS INT) AS shard, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 2 ORDER BY c_custkey) - 1 AS id, concat_ws(',', c_custkey, CAST(floor(c_acctbal) AS BIGINT)) AS vals FROM customer",
        "rows_in_memory": "SELECT row_number() OVER (PARTITION BY flat ORDER BY n_nationkey) - 1 AS id, flat, concat_ws(',', n_nationkey, n_regionkey) AS vals FROM nation, (VALUES (false), (true)) AS t(flat)",
        "rows_from_flat": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, concat_ws(',', p_size, CAST(floor(p_retailprice) AS INT), p_partkey % 31) AS vals FROM part",
        "search_files": _sql(FILE_POINTS, "SELECT id AS qid, dim, value - 2 AS lo, value + 2 AS up FROM pts WHERE id < 100"),
        "search_in_index": _sql(ORDER_POINTS, _self("value - 1", "value + 1")),
        "index_from_text": f"WITH {FILE_POINTS} SELECT CAST(dim AS INT) AS dim, value, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM pts GROUP BY dim, value",
        "stored_bounds": f"{part} SELECT dim, min(value) AS least, max(value) AS most, count(DISTINCT value) AS n_values, count(*) AS n_points FROM pts GROUP BY dim",
        "results_as_text": f"SELECT row_number() OVER (ORDER BY qid, rnk) - 1 AS id, concat_ws(',', id, cnt) AS vals FROM ({_sql(PART_POINTS, ONE)})",
        "all_counts": f"{part} SELECT q.id AS qid, d.id, count(*) AS cnt FROM pts d JOIN pts q ON q.id % 100 = 0 AND d.dim = q.dim AND d.value BETWEEN q.value - 1 AND q.value + 1 GROUP BY q.id, d.id",
        "all_matches": f"{part} SELECT q.id AS qid, d.id, d.dim, d.value FROM pts d JOIN pts q ON q.id % 100 = 0 AND d.dim = q.dim AND d.value = q.value",
        "wide_ranges": _sql(ORDER_POINTS, "SELECT id AS qid, dim, value - CASE dim WHEN 0 THEN 3000 ELSE 5 END AS lo, value + CASE dim WHEN 0 THEN 3000 ELSE 5 END AS up FROM pts WHERE id % 100 = 0 AND dim IN (0, 2)"),
        "all_wide_counts": f"""WITH {ORDER_POINTS}, w AS (SELECT id, dim, value, value - CASE dim WHEN 0 THEN 3000 ELSE 5 END AS lo, value + CASE dim WHEN 0 THEN 3000 ELSE 5 END AS up FROM pts WHERE id % 100 = 0 AND dim IN (0, 2)),
          c AS (SELECT w.id AS qid, d.id, count(*) AS cnt FROM pts d JOIN w ON d.dim = w.dim AND d.value BETWEEN w.lo AND w.up GROUP BY w.id, d.id)
          SELECT qid, cnt, count(*) AS n_rows FROM c GROUP BY qid, cnt""",
        "single_range_search": _sql(PART_POINTS, _self("value - 1", "value + 1")),
        "policy_search": _sql(PARITY, ONE),
        "policy_from_files": _sql(FILE_POINTS, "SELECT id AS qid, dim, value - 3 AS lo, value + 3 AS up FROM pts WHERE id < 100"),
        "tables_as_lines": f"{part} SELECT dim, format('dim {{}}: [{{}}, {{}}], {{}} values, {{}} points', dim, min(value), max(value), count(DISTINCT value), count(*)) AS line FROM pts GROUP BY dim",
        "results_as_lines": f"SELECT qid, 'query ' || qid || ': ' || string_agg(id || ':' || cnt, ' ' ORDER BY rnk) AS line FROM ({_sql(PART_POINTS, ONE)}) GROUP BY qid",
        "lists_as_lines": f"{part} SELECT dim, value, id // 1024 AS part, 'dim ' || dim || ' value ' || value || ': ' || string_agg(id, ' ' ORDER BY id) AS line FROM pts GROUP BY dim, value, part",
        "grounded_sequences": f"WITH {SEQUENCES}, l AS (SELECT min(list_min(v)) AS least FROM s) SELECT id, array_to_string(list_transform(v, lambda x: x - least), ',') AS vals FROM s, l",
        "appended_dims": _sql(APPENDED, ONE),
        "chunk_sizes": f"{part} SELECT id // 700 AS chunk, count(*) AS n_points, count(DISTINCT id) AS n_rows FROM pts GROUP BY chunk",
        "clamped_predicates": f"""{part}, b AS (SELECT dim, min(value) AS least, max(value) AS most FROM pts GROUP BY dim),
          q AS (SELECT id AS qid, dim, value - 30 + CASE WHEN id % 300 = 0 THEN 2000 ELSE 0 END AS lo, value + 30 + CASE WHEN id % 300 = 0 THEN 2000 ELSE 0 END AS up FROM pts WHERE id % 100 = 0)
          SELECT qid, dim, greatest(lo, least) AS lo, least(up, most) AS up FROM q JOIN b USING (dim) WHERE greatest(lo, least) <= least(up, most)""",
        "ranges_counted": f"{part} SELECT id AS qid, 2 * count(*) AS n_ranges, count(*) AS n_dims FROM pts WHERE id % 100 = 0 AND dim <> 2 AND NOT (dim = 1 AND id = 200) GROUP BY id",
        "ranges_as_lines": f"{part} SELECT id AS qid, format('{{}} {{}} {{}} [{{}}, {{}}] 1.000 0.000', id, dim, dim, value - 2, value + 2) AS line FROM pts WHERE id % 100 = 0",
        "points_covered": f"{part} SELECT q.id AS qid, q.dim, count(*) AS covered FROM pts q JOIN pts d ON d.dim = q.dim AND d.value BETWEEN q.value - 4 AND q.value + 4 WHERE q.id % 100 = 0 GROUP BY q.id, q.dim",
        "k_by_query": _sql(PART_POINTS, ONE, where="rnk <= CAST(floor(qid / 100 % 7) AS INT) + 1"),
        "first_of_the_queries": f"{part} SELECT id AS qid, dim, value AS lo FROM pts WHERE id IN (SELECT DISTINCT id FROM pts WHERE id % 100 = 0 ORDER BY id LIMIT 12)",
        "several_tables": f"""{part}, c AS (SELECT CAST(d.id % 3 AS INT) AS "table", q.id AS qid, d.id, count(*) AS cnt FROM pts d JOIN pts q ON q.id % 100 = 0 AND d.dim = q.dim AND d.value = q.value GROUP BY q.id, d.id)
          SELECT * FROM (SELECT *, {TOP.format('"table", qid')} FROM c) WHERE rnk <= 10""",
        "lists_analyzed": f"{part}, {WORDS}, z AS (SELECT dim, value, CAST(4 * sum(w) AS BIGINT) AS compressed_bytes FROM size WHERE codec = 'heavy' GROUP BY dim, value) SELECT * FROM (SELECT dim, value, count(*) AS n, min(id) AS first_id, max(id) AS last_id, 4 * count(*) AS bytes FROM pts GROUP BY dim, value) JOIN z USING (dim, value)",
        "packed_ids": f"WITH {SEQUENCES} SELECT id * 4096 + pos AS packed, id AS row, pos AS place, value FROM (SELECT id, unnest(range(len(v))) AS pos, unnest(v) AS value FROM s)",
        "prefix_sums": "SELECT p_partkey, CAST(p_size AS BIGINT) AS n, CAST(coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM part",
        "fields_as_integers": "SELECT c_custkey, coalesce(TRY_CAST(regexp_extract(substr(c_name, 8, 20), '^\\s*([+-]?[0-9]+)', 1) AS INT), 0) AS tail, -c_nationkey AS signed, 0 AS none FROM customer",
        "sequence_bounds": f"WITH {SEQUENCES} SELECT min(list_min(v)) AS least, max(list_max(v)) AS most FROM s",
        "query_documents": f"{part} SELECT 3 AS topk, v[1] % 5 AS cluster, array_to_string(v, ',') AS vals FROM o WHERE id % 100 = 0",
        "service_batch": service,
        "service_by_settings": f"""{part}, o2 AS (SELECT v, v[1] % 6 AS c, id FROM o WHERE v[1] % 6 < 5),
          d AS (SELECT v, c, row_number() OVER (ORDER BY c, id) - 1 AS id FROM o2),
          q AS (SELECT DISTINCT v, v[1] % 6 AS c FROM o WHERE id % 100 = 0 AND v[1] % 6 < 5), n AS (SELECT v, count(*) AS times FROM o WHERE id % 100 = 0 GROUP BY v),
          cnts AS (SELECT q.v, d.id, CAST(abs(d.v[1] - q.v[1]) <= 1 AS BIGINT) + CAST(abs(d.v[2] - q.v[2]) <= 1 AS BIGINT) + CAST(abs(d.v[3] - q.v[3]) <= 1 AS BIGINT) AS cnt FROM q JOIN d USING (c)),
          top AS (SELECT v, id, cnt, {TOP.format("v")} FROM cnts WHERE cnt > 0)
          SELECT id, cnt, rnk, CAST(sum(times) AS BIGINT) AS answers FROM top JOIN n USING (v) WHERE rnk <= 3 GROUP BY id, cnt, rnk""",
        "clusters_by_kmeans": "SELECT count(*) AS n, 5 AS clusters, true AS nearly_all FROM part",
        "clusters_split": f"{part} SELECT v[1] % 5 AS cluster, count(*) AS n, count(*) AS ids, CAST(sum(id) AS BIGINT) AS sum_of_ids, true AS own_shard, 3 AS shards FROM o GROUP BY v[1] % 5",
        "figures_of_a_search": f"""{part}, p AS (SELECT * FROM pts WHERE id % 100 = 0), c AS (SELECT DISTINCT p.id AS q, d.id FROM pts d JOIN p ON d.dim = p.dim AND d.value BETWEEN p.value - 1 AND p.value + 1)
          SELECT 'no' AS codec, (SELECT count(*) FROM pts) AS "invSize", (SELECT count(*) FROM p) AS "dimsSize", (SELECT CAST(sum(least(n, 10)) AS BIGINT) FROM (SELECT count(*) AS n FROM c GROUP BY q)) AS "topksSize" """,
    }


def queries() -> dict[str, Query]:
    own = [
        rows_from_text, rows_first, rows_converted, predicates_long_form, multirange_from_text, radius_queries_from_text, clusters_from_files, rows_in_memory, rows_from_flat, search_files, search_in_index,
        index_from_text, stored_bounds, results_as_text, all_counts, all_matches, wide_ranges, all_wide_counts, single_range_search, policy_search, policy_from_files, tables_as_lines, results_as_lines, lists_as_lines, grounded_sequences, appended_dims, chunk_sizes, clamped_predicates, ranges_counted,
        ranges_as_lines, points_covered, k_by_query, first_of_the_queries, several_tables, lists_analyzed, packed_ids, prefix_sums, fields_as_integers, sequence_bounds, query_documents, service_batch, service_by_settings, clusters_by_kmeans, clusters_split, figures_of_a_search,
    ]
    return {f.__name__: f for f in own}
