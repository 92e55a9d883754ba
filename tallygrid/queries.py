"""The registered queries of the search engine, over whole tables; searches ask for every row whose id 100 divides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, codecs
from .metrics import codec_sizes
from .operators import clusters, points, predicates, stats, topk
from .operators.match import match
from .operators.shared import nearest
from .plans import engine
from .sources import index
from .workers import importable
from .workspace import workspace

Query = Callable[[SparkSession, str], DataFrame]
K = 10
EVENTS = ["click", "error", "purchase", "signup", "view"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, by_id: bool = False) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    dims = {"custkey": F.col("o_custkey"), "price": F.floor(F.col("o_totalprice") / 1000), "day": day, "c": F.col("o_custkey") % 97, "o": F.col("o_orderkey") % 89}
    return points.column_points(_table(spark, sf_dir, "orders"), "o_orderkey", dims, by_id)


def _parts(spark: SparkSession, sf_dir: str, by_id: bool = False) -> DataFrame:
    dims = {"size": F.col("p_size"), "price": F.floor(F.col("p_retailprice")), "k": F.col("p_partkey") % 31}
    return points.column_points(_table(spark, sf_dir, "part"), "p_partkey", dims, by_id)


def _asked(at: DataFrame, radius: int = 0) -> DataFrame:
    preds = predicates.as_predicates(at.where(F.col("id") % 100 == 0))
    return preds.withColumn("lo", F.col("lo") - radius).withColumn("up", F.col("up") + radius) if radius else preds


def _out(top: DataFrame, *more: str) -> DataFrame:
    return top.select("qid", "id", *more, "cnt", F.col("rnk").cast("long").alias("rnk"))


ORDER_POINTS = """o AS (SELECT o_orderkey AS id, [CAST(o_custkey AS INT), CAST(floor(o_totalprice / 1000) AS INT),
  CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INT), CAST(o_custkey % 97 AS INT), CAST(o_orderkey % 89 AS INT)] AS v FROM orders),
pts AS (SELECT id, unnest(range(5)) AS dim, unnest(v) AS value FROM o)"""
PART_POINTS = """o AS (SELECT p_partkey AS id, [CAST(p_size AS INT), CAST(floor(p_retailprice) AS INT), CAST(p_partkey % 31 AS INT)] AS v FROM part),
pts AS (SELECT id, unnest(range(3)) AS dim, unnest(v) AS value FROM o)"""


def _sql(pts: str, preds: str, count: str = "count(*)", where: str = "rnk <= 10", order: str = "cnt DESC, id") -> str:
    return f"""WITH RECURSIVE {pts}, preds AS ({preds}),
hits AS (SELECT p.qid, d.id, CAST({count} AS BIGINT) AS cnt FROM pts d JOIN preds p ON d.dim = p.dim AND d.value BETWEEN p.lo AND p.up GROUP BY p.qid, d.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rnk FROM hits)
SELECT qid, id, cnt, rnk FROM ranked WHERE {where}"""


def _self(lo: str = "value", up: str = "value", more: str = "", where: str = "") -> str:
    return f"SELECT id AS qid, dim, {lo} AS lo, {up} AS up{more} FROM pts WHERE id % 100 = 0{where}"


def match_vector_point(spark, sf_dir):
    return _out(nearest(_orders(spark, sf_dir), _asked(_orders(spark, sf_dir)), K, exact=True))


def match_vector_radius(spark, sf_dir):
    return _out(nearest(_orders(spark, sf_dir), _asked(_orders(spark, sf_dir), 1), K))


def match_subset_dims(spark, sf_dir):
    """Only two of the dims are asked."""
    at = _parts(spark, sf_dir)
    return _out(nearest(at, predicates.valid(_asked(at, 2), 2), K))


def _two_ranges(at: DataFrame) -> DataFrame:
    one = _asked(at)
    return one.withColumn("up", F.col("up") + 2).unionByName(one.withColumn("lo", F.col("lo") - 9).withColumn("up", F.col("up") - 4))


def match_multirange(spark, sf_dir):
    """Two ranges for each dim of a query."""
    at = _parts(spark, sf_dir)
    return _out(nearest(at, _two_ranges(at), K))


def weighted_match(spark, sf_dir):
    at = _parts(spark, sf_dir)
    preds = _asked(at, 1).withColumn("weight", F.col("dim") + 0.5)
    return _out(nearest(at, preds, K, weighted=True).withColumn("cnt", (F.col("cnt") * 2).cast("long")))


def topk_page2(spark, sf_dir):
    return _out(nearest(_orders(spark, sf_dir), _asked(_orders(spark, sf_dir)), K, exact=True, page=2))


def pad_topk(spark, sf_dir):
    at = _parts(spark, sf_dir)
    preds = _asked(at).where("dim = 1")
    return _out(topk.pad(nearest(at, preds, K, exact=True), preds, K))


def topk_ids_descending(spark, sf_dir):
    at = _parts(spark, sf_dir)
    return _out(nearest(at, _asked(at), K, exact=True, descending_ids=True))


def match_capped(spark, sf_dir):
    at = _parts(spark, sf_dir)
    return _out(nearest(at, _asked(at, 3), K, cap=2))


def _embeddings(spark: SparkSession, sf_dir: str, by_id: bool = False) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 16).cast("int")).alias("values"))
    return points.vector_points(points.dealt(rows) if by_id else rows)


def match_embedding_bucket(spark, sf_dir):
    return _out(topk.top_k(match(_embeddings(spark, sf_dir, True), _asked(_embeddings(spark, sf_dir)), exact=True, by_id=True), K))


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return at.select(F.col("doc_id").alias("id"), F.array_remove(F.split("text", " "), "").alias("values"))


def match_bag(spark, sf_dir):
    rows = _bags(spark, sf_dir)
    return _out(engine.search_bags(rows, rows.where("id % 100 = 0"), K))


def match_bag_capped(spark, sf_dir):
    rows = _bags(spark, sf_dir)
    return _out(engine.search_bags(rows, rows.where("id % 100 = 0"), K, cap=16))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of each user's events, by time."""
    at = _table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event_type")).cast("int").alias("code")).alias("e"))
    return at.groupBy(F.col("user_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e.code).alias("values"))


def match_subsequence_events(spark, sf_dir):
    rows = _sequences(spark, sf_dir)
    return _out(engine.search_subsequences(rows, rows.where("id % 100 = 0"), K), "offset")


def match_ngram_sequence(spark, sf_dir):
    rows = _sequences(spark, sf_dir)
    return _out(engine.search_sequences(rows, rows.where("id % 100 = 0"), K))


def adaptive_range(spark, sf_dir):
    at = _parts(spark, sf_dir)
    return predicates.widen(_asked(at), at, 0.2, _table(spark, sf_dir, "part").count()).select("qid", "dim", "lo", "up")


def adaptive_match(spark, sf_dir):
    at = _parts(spark, sf_dir)
    return _out(engine.search_adaptive(at, _asked(at), K, 0.2, _table(spark, sf_dir, "part").count()))


def cluster_routed(spark, sf_dir):
    """Parts are in clusters by brand, in an index with a folder for each; a query goes to its own."""
    brand = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster"))
    at = _parts(spark, sf_dir).join(brand, "id")
    preds = _asked(at, 2).join(brand.withColumnRenamed("id", "qid"), "qid")
    index.save_index(at, path := workspace(spark, "clusters"), 4, by=("cluster",))
    return _out(clusters.search_clusters(index.load_index(spark, path), preds, K, exact=False, by_id=True))


def multiload_merge(spark, sf_dir):
    at = _parts(spark, sf_dir)
    return _out(engine.search_chunks(at, _asked(at, 1), K, 700))


def index_stats(spark, sf_dir):
    return stats.postings(_orders(spark, sf_dir))


def index_bounds(spark, sf_dir):
    return stats.bounds(_orders(spark, sf_dir))


def posting_deltas(spark, sf_dir):
    return stats.deltas(_parts(spark, sf_dir))


def posting_lengths(spark, sf_dir):
    return stats.list_sizes(_orders(spark, sf_dir))


def id_offsets(spark, sf_dir):
    at = _table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cluster")).agg(F.count("*").alias("n"))
    return topk.id_offsets(at, ["cluster"])


def query_json_parse(spark, sf_dir):
    """Customers as query documents; those of no nation from 20 on lack a field and are dropped."""
    at = _table(spark, sf_dir, "customer")
    one = F.struct(F.array("c_nationkey", (F.col("c_custkey") % 100).cast("int")).alias("content"), F.when(F.col("c_nationkey") < 20, F.array("c_nationkey")).alias("clusters"))
    at = at.select(F.col("c_custkey").alias("doc"), F.to_json(F.struct(F.lit(5).alias("topk"), F.array(one).alias("queries"))).alias("value"))
    return clusters.parse_queries(at).select("doc", "topk", F.col("qid").cast("long").alias("qid"), F.element_at("content", 1).alias("c1"), F.element_at("content", 2).alias("c2"), F.element_at("clusters", 1).alias("cluster"))


def gram_codes(spark, sf_dir):
    rows = _sequences(spark, sf_dir)
    at = rows.select("id", F.posexplode(arrays.grams(F.col("values"), 3)).alias("pos", "g"))
    return at.select("id", F.col("pos").cast("long").alias("pos"), arrays.gram_code(F.col("g"), F.lit(13)).alias("code"))


def codec_delta(spark, sf_dir):
    rows = _sequences(spark, sf_dir).select("id", arrays.delta(F.col("values")).alias("d"), "values")
    back = arrays.undelta(F.col("d"))
    return rows.select("id", F.array_join("d", ",").alias("deltas"), (back == F.col("values").cast("array<bigint>")).alias("same"))


def codec_round_trip(spark, sf_dir):
    """Every codec over every user's sequence: how many come back as they were."""
    importable(spark)
    names = [*codecs.CODECS]
    rows = _sequences(spark, sf_dir).select(F.posexplode(codecs.all_round_trips(F.col("values").cast("array<bigint>"), names)).alias("k", "ok"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
    return rows.groupBy(name.alias("codec")).agg(F.count("*").alias("lists"), F.sum(F.col("ok").cast("long")).alias("same"))


def codec_bits(spark, sf_dir):
    return codec_sizes(_parts(spark, sf_dir), [*codecs.CODECS])


SEQUENCES = f"""s AS (SELECT user_id AS id, list(code ORDER BY ts, event_id) AS v
  FROM (SELECT *, CAST(list_position({EVENTS}, event_type) AS INT) AS code FROM events) GROUP BY user_id)"""
GRAMS = """gr AS (SELECT id, pos, v[pos:pos + 2] AS g FROM (SELECT id, v, unnest(range(1, len(v) - 1)) AS pos FROM s WHERE len(v) >= 3)
  UNION ALL SELECT id, 1 AS pos, v || CASE len(v) WHEN 1 THEN [v[1], v[1]] ELSE [v[1]] END AS g FROM s WHERE len(v) BETWEEN 1 AND 2)"""
BAGS = """b AS (SELECT doc_id AS id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS value FROM documents WHERE text IS NOT NULL),
pts AS (SELECT id, 0 AS dim, value FROM b)"""
GROWN = """h AS (SELECT dim, value, count(*) AS n FROM pts GROUP BY dim, value),
bd AS (SELECT dim, min(value) AS least, max(value) AS most FROM pts GROUP BY dim),
need AS (SELECT CAST(ceil(0.2 * count(DISTINCT id)) AS BIGINT) AS need FROM pts),
grow AS (SELECT id AS qid, dim, value AS lo, value AS up FROM pts WHERE id % 100 = 0
  UNION ALL
  SELECT g.qid, g.dim, CASE WHEN lo > 0 THEN lo - 1 ELSE lo END,
         CASE WHEN (lo > 0 AND lo - 1 < least) OR up + 1 > most THEN up ELSE up + 1 END
  FROM grow g JOIN bd USING (dim), need
  WHERE (SELECT coalesce(sum(n), 0) FROM h WHERE h.dim = g.dim AND h.value BETWEEN g.lo AND g.up) < need AND NOT (lo = 0 AND up = most)),
wide AS (SELECT qid, dim, min(lo) AS lo, max(up) AS up FROM grow GROUP BY qid, dim)"""
#: Words of each block of at most 1,024 ids of a posting list: plain and by deltas, bit-packed and in bytes; `most` is the
#: part that 8 divides, `rest` what is left.
WORDS = """f AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY dim, value, part) AS n, id - coalesce(lag(id) OVER w, 0) AS delta
  FROM (SELECT dim, value, id, id // 1024 AS part FROM pts) WINDOW w AS (PARTITION BY dim, value, part ORDER BY id)),
v AS (SELECT 'plain' AS form, dim, value, part, n, i, id AS x FROM f UNION ALL SELECT 'delta', dim, value, part, n, i, delta FROM f),
b AS (SELECT *, i < n // 8 * 8 AS most, CASE WHEN x = 0 THEN 0 ELSE length(bin(x)) END AS bits, 1 + CAST(x >= 128 AS INT) + CAST(x >= 16384 AS INT) + CAST(x >= 2097152 AS INT) + CAST(x >= 268435456 AS INT) AS bytes FROM v),
mini AS (SELECT form, dim, value, part, n, max(bits) AS w, coalesce(max(bits) FILTER (most), 0) AS wm, sum(bytes) AS y, coalesce(sum(bytes) FILTER (NOT most), 0) AS yr FROM b GROUP BY form, dim, value, part, n, i // 32),
l AS (SELECT form, dim, value, part, n, 1 + (n + 127) // 128 + sum(w) AS bp, 1 + (n // 8 * 8 + 127) // 128 + sum(wm) AS bpm, (sum(y) + 3) // 4 AS vi, (sum(yr) + 3) // 4 AS vir FROM mini GROUP BY form, dim, value, part, n),
size AS (SELECT k.codec, l.dim, l.value, l.n, CASE k.kind WHEN 'copy' THEN n WHEN 'bp' THEN bp WHEN 'vi' THEN vi WHEN 'bpc' THEN 1 + bpm + n % 8 ELSE 1 + bpm + vir END AS w
  FROM l JOIN (VALUES ('no', 'plain', 'copy'), ('copy', 'plain', 'copy'), ('copy-copy', 'plain', 'copy'), ('delta', 'delta', 'copy'), ('delta-copy', 'delta', 'copy'), ('delta-delta', 'delta', 'copy'),
    ('bp32', 'plain', 'bp'), ('light', 'plain', 'bp'), ('delta-bp32', 'delta', 'bp'), ('middle', 'delta', 'bp'), ('varint', 'plain', 'vi'), ('delta-varint', 'delta', 'vi'),
    ('bp32-copy', 'plain', 'bpc'), ('delta-bp32-copy', 'delta', 'bpc'), ('bp32-varint', 'plain', 'bpv'), ('delta-bp32-varint', 'delta', 'bpv'), ('heavy', 'delta', 'bpv')) AS k(codec, form, kind) USING (form))"""
ROUTED = """SELECT qid, id, cnt, rnk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cnt DESC, id) AS rnk FROM (
  SELECT q.id AS qid, d.id, count(*) AS cnt FROM pts d JOIN pts q ON q.id % 100 = 0 AND d.dim = q.dim AND d.value BETWEEN q.value - 2 AND q.value + 2
  JOIN part a ON a.p_partkey = d.id JOIN part b ON b.p_partkey = q.id WHERE a.p_brand = b.p_brand GROUP BY q.id, d.id)) WHERE rnk <= 10"""
ONE = "SELECT id AS qid, dim, value AS lo, value AS up FROM pts WHERE id % 100 = 0"


def oracle_sql() -> dict[str, str]:
    """For each query; of codecs, what they must give: lists that come back, and sizes worked out from the values."""
    near = _self("value - 1", "value + 1")
    top = "row_number() OVER (PARTITION BY qid ORDER BY cnt DESC, id) AS rnk"
    return {
        "match_vector_point": _sql(ORDER_POINTS, ONE),
        "match_vector_radius": _sql(ORDER_POINTS, near),
        "match_subset_dims": _sql(PART_POINTS, _self("value - 2", "value + 2", where=" AND dim < 2")),
        "match_multirange": _sql(PART_POINTS, f"{_self('value', 'value + 2')} UNION ALL {_self('value - 9', 'value - 4')}"),
        "weighted_match": _sql(PART_POINTS, _self("value - 1", "value + 1", ", dim + 0.5 AS weight"), "2 * sum(weight)"),
        "topk_page2": _sql(ORDER_POINTS, ONE, where="rnk > 10 AND rnk <= 20"),
        "pad_topk": f"""SELECT q.qid, coalesce(t.id, 0) AS id, coalesce(t.cnt, 0) AS cnt, q.rnk FROM
          (SELECT p_partkey AS qid, unnest(range(1, 11)) AS rnk FROM part WHERE p_partkey % 100 = 0) q LEFT JOIN ({_sql(PART_POINTS, _self(where=" AND dim = 1"))}) t USING (qid, rnk)""",
        "topk_ids_descending": _sql(PART_POINTS, ONE, order="cnt DESC, id DESC"),
        "match_capped": _sql(PART_POINTS, _self("value - 3", "value + 3"), "least(count(*), 2)"),
        "match_embedding_bucket": _sql("pts AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS dim, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 16) AS INT) AS value FROM embeddings)", ONE),
        "match_bag": f"WITH {BAGS}, n AS (SELECT id, value, count(*) AS n FROM pts GROUP BY ALL), c AS (SELECT q.id AS qid, d.id, CAST(sum(q.n * d.n) AS BIGINT) AS cnt FROM n d JOIN n q ON q.id % 100 = 0 AND q.value = d.value GROUP BY q.id, d.id) SELECT * FROM (SELECT *, {top} FROM c) WHERE rnk <= 10",
        "match_bag_capped": f"WITH {BAGS}, n AS (SELECT id, value, count(*) AS n FROM pts GROUP BY ALL), c AS (SELECT q.id AS qid, d.id, CAST(least(sum(q.n * d.n), 16) AS BIGINT) AS cnt FROM n d JOIN n q ON q.id % 100 = 0 AND q.value = d.value GROUP BY q.id, d.id) SELECT * FROM (SELECT *, {top} FROM c) WHERE rnk <= 10",
        "match_subsequence_events": f"""WITH {SEQUENCES}, p AS (SELECT id, unnest(range(len(v))) AS pos, unnest(v) AS value FROM s),
          c AS (SELECT q.id AS qid, d.id, d.pos - q.pos AS "offset", count(*) AS cnt FROM p d JOIN p q ON q.id % 100 = 0 AND q.value = d.value AND d.pos >= q.pos GROUP BY ALL)
          SELECT qid, id, CAST("offset" AS INT) AS "offset", cnt, rnk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cnt DESC, id, "offset") AS rnk FROM c) WHERE rnk <= 10""",
        "match_ngram_sequence": f"""WITH {SEQUENCES}, {GRAMS}, n AS (SELECT id, g, count(*) AS n FROM gr GROUP BY ALL),
          c AS (SELECT q.id AS qid, d.id, CAST(sum(least(q.n, d.n) + greatest(0, least(q.n, 64) - 63) * greatest(d.n - 64, 0)) AS BIGINT) AS cnt FROM n d JOIN n q ON q.id % 100 = 0 AND q.g = d.g GROUP BY q.id, d.id)
          SELECT * FROM (SELECT *, {top} FROM c) WHERE rnk <= 10""",
        "adaptive_range": f"WITH RECURSIVE {PART_POINTS}, {GROWN} SELECT * FROM wide",
        "adaptive_match": _sql(f"{PART_POINTS}, {GROWN}", "SELECT * FROM wide"),
        "cluster_routed": f"WITH {PART_POINTS} {ROUTED}",
        "multiload_merge": _sql(PART_POINTS, near),
        "index_stats": f"WITH {ORDER_POINTS} SELECT dim, value, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM pts GROUP BY dim, value",
        "index_bounds": f"WITH {ORDER_POINTS} SELECT dim, min(value) AS least, max(value) AS most, count(DISTINCT value) AS n_values, count(*) AS n_points FROM pts GROUP BY dim",
        "posting_deltas": f"WITH {PART_POINTS} SELECT dim, value, id, id - coalesce(lag(id) OVER (PARTITION BY dim, value ORDER BY id), 0) AS delta FROM pts",
        "posting_lengths": f"WITH {ORDER_POINTS} SELECT n, count(*) AS n_lists FROM (SELECT count(*) AS n FROM pts GROUP BY dim, value) GROUP BY n",
        "id_offsets": 'SELECT cluster, n, CAST(sum(n) OVER (ORDER BY cluster) - n AS BIGINT) AS "offset" FROM (SELECT p_brand AS cluster, count(*) AS n FROM part GROUP BY p_brand)',
        "query_json_parse": "SELECT c_custkey AS doc, 5 AS topk, CAST(0 AS BIGINT) AS qid, c_nationkey AS c1, CAST(c_custkey % 100 AS INT) AS c2, c_nationkey AS cluster FROM customer WHERE c_nationkey < 20",
        "gram_codes": f"WITH {SEQUENCES}, {GRAMS} SELECT id, CAST(pos - 1 AS BIGINT) AS pos, CAST(g[1] * 169 + g[2] * 13 + g[3] AS BIGINT) AS code FROM gr",
        "codec_delta": f"""WITH {SEQUENCES} SELECT id, array_to_string(list_transform(range(1, len(v) + 1), lambda k: (v[k] - CASE WHEN k > 1 THEN v[k - 1] ELSE 0 END + 4294967296) % 4294967296), ',') AS deltas, true AS same FROM s""",
        "codec_round_trip": f"WITH {SEQUENCES} SELECT codec, n AS lists, n AS same FROM (SELECT count(*) AS n FROM s), (SELECT unnest({[*codecs.CODECS]}) AS codec)",
        "codec_bits": f"WITH {PART_POINTS}, {WORDS} SELECT codec, count(*) AS lists, CAST(sum(n) AS BIGINT) AS ints, CAST(sum(w) AS BIGINT) AS words, CAST(32 AS DOUBLE) * CAST(sum(w) AS BIGINT) / CAST(sum(n) AS BIGINT) AS bits_per_int FROM size GROUP BY codec",
    }


def queries() -> dict[str, Query]:
    own = [
        match_vector_point, match_vector_radius, match_subset_dims, match_multirange, weighted_match, topk_page2, pad_topk, topk_ids_descending, match_capped,
        match_embedding_bucket, match_bag, match_bag_capped, match_subsequence_events, match_ngram_sequence, adaptive_range, adaptive_match, cluster_routed,
        multiload_merge, index_stats, index_bounds, posting_deltas, posting_lengths, id_offsets, query_json_parse, gram_codes, codec_delta, codec_round_trip, codec_bits,
    ]
    return {f.__name__: f for f in own}
