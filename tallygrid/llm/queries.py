"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, codes, decontam, exact_dedup, forest, fst, katz, langid, repeats, resample, urls, warc
from .shared import importable, workspace

Query = Callable[[SparkSession, str], DataFrame]

def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, on any machine."""
    from public_tokenizers import path

    return path(name)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: (verdict, host, path prefix)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH t AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text) AS seq FROM conversations),
who AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role IS NOT NULL AND role <> 'system'),
x AS (SELECT t.conv_id, speaker, seq, (seq - 1) // 64 AS part, coalesce(role = speaker, false) AS own, text || '<|im_end|>' AS body,
             '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || coalesce(role, 'unknown') END || chr(10) AS head
      FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id),
y AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY seq) - length(body) - 1 AS pos FROM x)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own, string_agg(head || body || chr(10), '' ORDER BY seq) AS text,
       coalesce(string_agg(CAST(pos AS BIGINT) || '-' || CAST(pos + length(body) AS BIGINT), ',' ORDER BY seq) FILTER (own), '') AS spans
FROM y GROUP BY conv_id, speaker, part
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.DigestIndex(spark).dedup(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, false) AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.classes(table(spark, sf_dir, "documents")).drop("stands")


OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') for i in range(1, len(w) - least(5, len(w)) + 2)])) AS s
      FROM w WHERE len(w) > 0),
reps AS (SELECT s, min(doc_id) AS rep FROM s GROUP BY s),
x AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM reps),
links AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.t = b.t AND a.rep <> b.rep
          GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
root AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
n AS (SELECT a AS rep, count(*) AS n_links FROM links GROUP BY a),
d AS (SELECT w.doc_id, coalesce(root.class_id, w.doc_id) AS class_id, coalesce(n.n_links, 0) AS n_links, coalesce(len(s.s), 0) AS n_shingles
      FROM w LEFT JOIN s USING (doc_id) LEFT JOIN reps ON reps.s = s.s LEFT JOIN root ON root.rep = reps.rep LEFT JOIN n ON n.rep = reps.rep)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, n_links, n_shingles FROM d
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bn AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
         FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
hits AS (SELECT s.doc_id, s.i, s.n, wins.item_id FROM starts s JOIN wins ON wins.n = s.n AND wins.win = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents")).drop("kept")


#: Texts as hexadecimal digits, in chunks that overlap by a string; each string by its digest.
OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, k, substr(h, 4000 * k + 1, 4398) AS x FROM (SELECT r, h, unnest(range((length(h) + 3999) // 4000)) AS k FROM d)),
s AS (SELECT r, 2000 * k + j AS p, md5(substr(x, 2 * j + 1, 400)) AS g
      FROM (SELECT r, k, x, unnest(range(least(2000, (length(x) - 400) // 2 + 1))) AS j FROM c WHERE length(x) >= 400)),
o AS (SELECT r, p FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
f AS (SELECT r, p, coalesce(p > 200 + lag(p) OVER (PARTITION BY r ORDER BY p), true) AS fresh FROM o),
n AS (SELECT r, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY r ORDER BY p) AS run FROM f),
runs AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM n GROUP BY r, run),
gone AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM runs GROUP BY r),
kept AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS lo, a AS hi FROM runs
         UNION ALL SELECT r, coalesce(last, 0), length(h) // 2 FROM d LEFT JOIN gone USING (r)),
rest AS (SELECT r, string_agg(substr(h, CAST(2 * lo + 1 AS BIGINT), CAST(2 * (hi - lo) AS BIGINT)), '' ORDER BY lo) AS k FROM kept JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d LEFT JOIN gone USING (r) JOIN rest USING (r)
"""


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst.count(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def _url_rules_sql() -> str:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return f"(VALUES {rows}) AS r(verdict, rule_host, rule_path)"


OP10_SQL = rf"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
fit AS (SELECT h.page_id, arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule,
               arg_max(r.verdict, length(r.rule_host || r.rule_path)) AS verdict
        FROM h JOIN {_url_rules_sql()} ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path)
        GROUP BY h.page_id)
-- The tables hold no canonical link and no redirect, so no alias is blocked; groups of aliases are tested by brute force.
SELECT h.page_id, h.host, h.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict, false AS alias_blocked
FROM h LEFT JOIN fit USING (page_id)
"""


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.write(table(spark, sf_dir, "pages"), path := workspace(spark, "warc"))
    found = warc.read(spark, path, payload=False).where("type <> 'warcinfo'")
    return found.select(
        warc.page_of(found["record_id"]).cast("long").alias("page_id"), "payload_bytes", "payload_digest", found["type"].alias("record_type"), warc.page_of(found["refers_to"]).cast("long").alias("refers_to")
    )


OP11_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h, n) END AS last FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM f
"""


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of the text x by its definition: a table of what each byte does, made from the polynomial, folded over the bytes.
CRC32_SQL = """
crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) AS r(b)),
crc AS (SELECT x, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(x))), lambda i: 16 * (instr('0123456789ABCDEF', substr(hex(encode(x)), 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode(x)), 2 * i + 2, 1)) - 1),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS crc FROM texts, crc_table)"""
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
f AS (SELECT r, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS x FROM d),
g AS (SELECT unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS x FROM b),
texts AS (SELECT DISTINCT x FROM (SELECT x FROM f UNION ALL SELECT x FROM g)), {CRC32_SQL.strip()},
s AS (SELECT crc % 10000 AS k, count(*) AS s FROM f JOIN crc USING (x) GROUP BY k),
t AS (SELECT crc % 10000 AS k, count(*) AS t FROM g JOIN crc USING (x) GROUP BY k),
n AS (SELECT (SELECT count(*) FROM f) AS s, (SELECT count(*) FROM g) AS t),
gain AS (SELECT k, CAST(floor(1000 * ln(CAST(coalesce(t.t, 0) + 1 AS DOUBLE) * CAST(n.s + 10000 AS DOUBLE) / (CAST(coalesce(s.s, 0) + 1 AS DOUBLE) * CAST(n.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
         FROM n, range(10000) AS r(k) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
w AS (SELECT r, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN crc USING (x) JOIN gain ON k = crc % 10000 GROUP BY r),
a AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM a),
o AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM a WHERE n_words >= 20) // 100 THEN place END AS rank FROM o
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """Each round in its turn: a: assignments of parts to entries; c: the entries then."""
    steps = []
    for k in range(7):
        steps.append(
            f"x{k} AS MATERIALIZED (SELECT v.r, v.p, c.e, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v JOIN c{k} c USING (p)),\n"
            f"a{k} AS MATERIALIZED (SELECT r, p, min(d) AS d, arg_min(e, d * 16 + e) AS e FROM x{k} GROUP BY r, p)"
        )
        if k < 6:
            means = ", ".join(f"CAST(floor(CAST(sum(v.q[{j}]) AS DOUBLE) / count(*)) AS BIGINT)" for j in range(1, 9))
            steps.append(
                f"m{k} AS (SELECT p, e, [{means}] AS q FROM a{k} JOIN v USING (r, p) GROUP BY p, e),\n"
                f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN m{k} m USING (p, e))"
            )
    rounds = ",\n".join(steps)
    return f"""
WITH f AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(e, lambda x: CAST(floor(4096 * x) AS BIGINT)) AS q FROM f
      WHERE len(list_filter(e, lambda x: coalesce(isfinite(x), false))) = len(e)),
v AS MATERIALIZED (SELECT r, p, q[8 * p + 1:8 * p + 8] AS q FROM k, range(8) AS s(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, q FROM v WHERE r <= 16),
{rounds},
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, e)) AS h FROM c6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN o USING (r), h
"""


def queries() -> dict[str, Query]:
    own = [op1_perspectives, op2_exact_dedup, op3_bpe, op4_near_duplicates, op5_decontaminate, op6_repeats, op7_katz, op8_language, op9_token_counts, op10_url_filter, op11_warc, op12_resample, op13_vector_codes]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it; the others are tested against brute force or the library."""
    return {"op1_perspectives": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op4_near_duplicates": OP4_SQL, "op5_decontaminate": OP5_SQL, "op6_repeats": OP6_SQL, "op10_url_filter": OP10_SQL, "op11_warc": OP11_SQL, "op12_resample": OP12_SQL, "op13_vector_codes": _op13_sql()}
