"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark window (a run of item words) is a set of word shingles. Shingles are ordered by how often the documents
hold them; a window that occurs whole has its rarest shingle in the document, so joining that one (the necessary prefix
for full containment) loses nothing. Position and length bounds drop starts that stick out, and what is left is compared
word by word. One pass over the texts serves frequencies, candidates and word counts; a second reads the texts of
documents with candidates only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, materialize, unused, words

#: Words in a shingle; windows of fewer words are one shingle.
SHINGLE = 5
#: The most rows (of a hash, or of a document's key) that are broadcast; more take a shuffled join.
BROADCAST_ROWS = 500_000


def _shingle(hashes: Column, at: Column, q: int) -> Column:
    return F.xxhash64(F.lit(q), *(F.get(hashes, at + k) for k in range(q)))


def _shingles(hashes: str, q: int) -> Column:
    """One for each word; those that run over the end meet no shingle of q words."""
    return F.transform(hashes, lambda _, i: _shingle(F.col(hashes), i, q))


def windows(benchmark: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, window, n): each run of `size` words of each item, joined by blanks; an item of fewer is one run."""
    at = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    at = at.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at"))
    return at.select("item_id", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("window"), "n").distinct()


def _parts(wins: DataFrame) -> DataFrame:
    """(window, n, q, j, h): the shingles of each window, j words from its start."""
    at = wins.select("window", "n").distinct()
    at = at.select("window", "n", F.least("n", F.lit(SHINGLE)).alias("q"), F.transform(F.split("window", " "), lambda w: F.xxhash64(w)).alias("wh"))
    at = at.select("window", "n", "q", "wh", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("q"))).alias("j"))
    kinds = [F.when(F.col("q") == q, _shingle(F.col("wh"), F.col("j"), q)) for q in range(1, SHINGLE + 1)]
    return at.select("window", "n", "q", "j", F.coalesce(*kinds).alias("h"))


def _text_key(text_col: str) -> Column:
    """With the id, tells rows apart; rows that repeat both are alike."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs.

    A word of a document is hit if it lies in an occurrence of a window of `size` item words (a shorter item, that has
    words, is one window). n_items counts the items with a window that occurs, items_sha256 is of their ids, sorted as
    strings and joined by commas. Null and empty texts have no words; items without words are ignored; an item whose id
    is null makes hits and isn't listed. Rows that repeat an id are judged each by its own text. An empty benchmark or
    documents table is no error. Other columns are ignored, whatever their names.
    """
    wins = materialize(windows(benchmark, size, item_col, item_text_col), "windows")
    parts = materialize(_parts(wins), "window-shingles")
    sizes = [r[0] for r in parts.select("q").distinct().orderBy("q").collect()]  # at most SHINGLE values
    key = ["id", "th"]

    # One row (at 0) heads each document and carries its number of words; the others are shingles that the benchmark has.
    head = 0x5EED
    at = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("th"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("wh"))
    runs = [_shingles("wh", q) for q in sizes]
    at = at.select("id", "th", F.size("wh").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(head).cast("long")), *runs)).alias("at", "h"))
    wanted = parts.select("h").distinct().union(docs.sparkSession.range(head, head + 1, 1, 1).toDF("h")).distinct()
    met = materialize(at.join(broadcast_if_small(wanted, BROADCAST_ROWS), "h").where((F.col("at") == 0) | (F.col("h") != head)), "shingles-met")

    often = met.where("at > 0").groupBy("h").agg(F.count("*").alias("often"))
    # A window with a shingle that no document holds can't occur; of the others, the rarest shingle stands for it.
    ranked = parts.join(often, "h", "left").groupBy("window", "n", "q").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "h", "j")).alias("p")).where("p.often > 0")
    prefix = ranked.select("window", "n", "q", "p.h", "p.j")
    which = reduce(lambda c, k: c.when(F.col("k") == k, sizes[k]), range(1, len(sizes)), F.when(F.col("k") == 0, sizes[0])) if sizes else F.lit(None).cast("int")
    place = met.where("at > 0").withColumn("k", F.floor((F.col("at") - 1) / F.col("n_words")).cast("int")).withColumn("pos", (F.col("at") - 1) % F.col("n_words")).withColumn("pq", which)
    held = place.join(prefix, "h").where("pq = q").withColumn("start", F.col("pos") - F.col("j")).where("start >= 0 AND start + n <= n_words")
    maybe = materialize(held.groupBy(*key).agg(F.collect_set(F.struct("start", "n", "window")).alias("maybe")), "candidates")

    texts = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("th"), F.col(text_col).alias("text"))
    some = broadcast_if_small(maybe.select(*key), BROADCAST_ROWS)
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"m.{k}")) for k in key]
    texts = texts.alias("t").join(some.alias("m"), same, "left_semi").groupBy(*key).agg(F.first("text").alias("text"))
    texts = texts.select(*key, words(F.col("text")).alias("w"))
    both = texts.alias("t").join(maybe.alias("m"), same).select("t.id", "t.th", "t.w", "m.maybe")
    sure = F.filter("maybe", lambda c: F.array_join(F.slice(F.col("w"), c.start + 1, c.n), " ") == c.window)
    hits = materialize(both.select(*key, sure.alias("hits")).where(F.size("hits") > 0), "hits")

    spans = F.array_sort(F.transform("hits", lambda c: F.struct(c.start.alias("a"), (c.start + c.n).alias("b"))))
    grown = F.aggregate(
        spans, F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("end")),
        lambda s, c: F.struct((s["n"] + F.greatest(F.lit(0), c.b - F.greatest(c.a, s["end"]))).cast("int").alias("n"), F.greatest(s["end"], c.b).cast("int").alias("end")),
    )
    counted = hits.select(*key, grown["n"].cast("long").alias("n_hit"))
    items = hits.select(*key, F.explode(F.array_distinct(F.transform("hits", lambda c: c.window))).alias("window"))
    items = items.join(wins.where("item_id IS NOT NULL").select("window", "item_id"), "window").groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("item_id")), ",").alias("items"), F.countDistinct("item_id").alias("n_items"))
    heads = met.where("at = 0").select(*key, F.col("n_words").cast("long").alias("n_words"))
    out = heads.alias("t").join(counted.alias("m"), same, "left").select("t.*", "m.n_hit")
    out = out.alias("t").join(items.alias("m"), same, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("t.id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("t.th").alias("text_key"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without a hit, with all their columns."""
    one, two = unused(docs, "dirty_id"), unused(docs, "dirty_key")
    found = find(docs, benchmark, size, id_col, text_col).where("contaminated").select(F.col(id_col).alias(one), F.col("text_key").alias(two)).distinct()
    found = broadcast_if_small(materialize(found, "contaminated"), BROADCAST_ROWS)
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(one)) & (_text_key(text_col) == F.col(two)), "left_anti")
