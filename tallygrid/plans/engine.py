"""Searches from rows to results. Planning looks at the sizes of the predicates, and of nothing else; the rest is lazy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import batched
from ..operators import points as P
from ..operators import predicates as Q
from ..operators.match import match, match_subsequence, plan
from ..operators.shared import nearest
from ..operators.topk import pad, top_k
from ..sources.index import reach, reached, segments
from ..sources.rows import read_rows


def build_index(rows: DataFrame) -> DataFrame:
    return P.vector_points(rows)


def build_queries(rows: DataFrame, config: Config, dims: int | None = None) -> DataFrame:
    return Q.radius_predicates(rows, config.query_range or 0, dims)


def match_queries(points: DataFrame, preds: DataFrame, config: Config, by_id: bool = False) -> DataFrame:
    """(qid, id, cnt, rnk): the k best rows of each query. by_id: the points are dealt by id already."""
    found = nearest(points, preds, config.k, exact=not config.query_range, cap=config.count_cap, by_id=by_id)
    return pad(found, preds, config.k) if config.pad else found


def search_index(spark: SparkSession, index: str, preds: DataFrame, config: Config) -> DataFrame:
    """A search in an index folder, of its segments one by one: of each, what the predicates can reach is read, and counts are
    complete where it is read; segments whose bounds they don't reach are left out."""
    asked = plan(preds, exact=not config.query_range)
    kept, each = reach(asked.preds), segments(spark, index)
    live = [p for p, b in each if len(each) == 1 or reached(b, asked.preds)] or [each[0][0]]
    found = [nearest(p.where(kept), asked, config.k, cap=config.count_cap, by_id=True) for p in live]
    best = found[0] if len(found) == 1 else top_k(P.append(*found).drop("rnk"), config.k)
    return pad(best, preds, config.k) if config.pad else best


def search(spark: SparkSession, table: str, queries: str, config: Config) -> DataFrame:
    """From text files (or an index folder as table) of rows; the first num_of_queries rows of queries are asked."""
    config.validate()
    preds = build_queries(read_rows(spark, queries, config.num_of_queries), config)
    if table.endswith((".csv", ".dat", ".txt")):
        return match_queries(build_index(P.dealt(read_rows(spark, table))), preds, config, by_id=True)
    return search_index(spark, table, preds, config)


def _batched(data: DataFrame, queries: DataFrame, how: dict) -> bool:
    """Whether the best are found by batches: of many rows, and unless counted in a way of its own."""
    return how.keys() <= {"cap"} and batched.whole(data, queries)


def search_bags(data: DataFrame, queries: DataFrame, k: int, radius: int = 0, **how) -> DataFrame:
    if not radius and _batched(data, queries, how):
        return batched.best_bags(data, queries, k, **how)
    return top_k(match(P.bag_points(P.dealt(data)), Q.bag_predicates(queries, radius), exact=not radius, by_id=True, **how), k)


def search_sequences(data: DataFrame, queries: DataFrame, k: int, n: int = 3, **how) -> DataFrame:
    """By runs of n values that two sequences have in common."""
    if _batched(data, queries, how):
        return batched.best_bags(P.gram_tokens(data, n), P.gram_tokens(queries, n, data=data), k, **how)
    return top_k(match(P.gram_points(P.dealt(data), n), P.gram_predicates(queries, data, n), exact=True, by_id=True, **how), k)


def search_subsequences(data: DataFrame, queries: DataFrame, k: int, **how) -> DataFrame:
    """(qid, id, offset, cnt, rnk)."""
    if _batched(data, queries, how) and (found := batched.best_offsets(data, queries, k, **how)) is not None:
        return found
    return top_k(match_subsequence(P.position_points(data), Q.bag_predicates(queries), **how), k, extra=("offset",))


def search_adaptive(points: DataFrame, preds: DataFrame, k: int, selectivity: float, rows: int | None = None) -> DataFrame:
    """Ranges grown until each covers this share of all rows; rows: their number, if known."""
    return nearest(points, Q.widen(preds, points, selectivity, rows), k)


def search_chunks(points: DataFrame, preds: DataFrame, k: int, size: int, **how) -> DataFrame:
    """By chunks of `size` ids, then together; the same as without chunks. Each key's k least ids are taken of each chunk, and
    then of what the chunks gave: no chunk has results for each query, of which there would be as many as chunks and queries."""
    return nearest(P.chunk(points, size), preds, k, chunk=("chunk",), **how)


def search_tables(tables: Sequence[DataFrame], preds: DataFrame, k: int, **how) -> DataFrame:
    """One search over several tables of points: (table, qid, id, cnt, rnk), the top k of each.

    Points carry the number of their table, by which they are counted apart: predicates are looked at and broadcast once.
    """
    at = P.append(*(t.withColumn("table", F.lit(n)) for n, t in enumerate(tables)))
    return nearest(at, preds, k, per=("table",), **how)
