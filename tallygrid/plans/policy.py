"""Policies: how rows become points, queries become predicates, and both are matched. Subclass one for encodings or
matching of one's own, and give it to search()."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import points as P
from ..operators import predicates as Q
from ..operators.match import match
from ..operators.shared import nearest
from ..operators.topk import pad, top_k
from ..sources.rows import read_rows


class Policy:
    """Vectors; a point matches that has the query's value in its dim."""

    exact = True

    def __init__(self, config: Config):
        self.config = config.validate()

    def points(self, rows: DataFrame) -> DataFrame:
        return P.vector_points(rows)

    def predicates(self, rows: DataFrame) -> DataFrame:
        return Q.radius_predicates(rows, 0)

    def counts(self, points: DataFrame, preds: DataFrame) -> DataFrame:
        return match(points, preds, exact=self.exact, cap=self.config.count_cap)

    def match(self, points: DataFrame, preds: DataFrame) -> DataFrame:
        """(qid, id, cnt, rnk)."""
        if type(self).counts is Policy.counts:
            found = nearest(points, preds, self.config.k, exact=self.exact, cap=self.config.count_cap)
        else:  # a way of counting of one's own
            found = top_k(self.counts(points, preds), self.config.k)
        return pad(found, preds, self.config.k) if self.config.pad else found

    def match_tables(self, tables: Sequence[DataFrame], preds: DataFrame) -> DataFrame:
        """(table, qid, id, cnt, rnk): the same queries of several tables."""
        return P.append(*(self.match(t, preds).select(F.lit(n).alias("table"), "*") for n, t in enumerate(tables)))


class SingleValue(Policy):
    pass


class SingleRange(Policy):
    """A point matches that lies within query_range of the query's value."""

    exact = False

    def predicates(self, rows: DataFrame) -> DataFrame:
        return Q.radius_predicates(rows, self.config.query_range)


class Bags(Policy):
    """Rows are bags of tokens."""

    def points(self, rows: DataFrame) -> DataFrame:
        return P.bag_points(rows)

    def predicates(self, rows: DataFrame) -> DataFrame:
        return Q.bag_predicates(rows)


def make_policy(config: Config) -> Policy:
    """By whether a range is set."""
    return SingleValue(config) if config.query_range is None else SingleRange(config)


def search(spark: SparkSession, policy: Policy, table: str, queries: str) -> DataFrame:
    """Of text files, by a policy."""
    asked = read_rows(spark, queries, policy.config.num_of_queries)
    return policy.match(policy.points(read_rows(spark, table)), policy.predicates(asked))
