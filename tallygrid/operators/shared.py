"""The best rows, and how many rows have which count, by the values that rows share with a query in sets of dims.

For rows with one value in a dim at most, and few dims. A row that matches a query in a set of dims is one of the best only if
fewer than k rows with lesser ids match in all of that set: those count as much. So of each set, and of each key (values in its
dims), the k least ids are all that a query needs. Rows become keys, as many as there are sets; queries ask for keys, as
many as their ranges have cells; no (query, row) pair is made but with those k. Work grows with rows and queries, not with their product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, product
from math import comb
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import materialize, settings
from .match import BROADCAST_ROWS, Planned, match, plan
from .topk import top_k

#: Predicates up to which all pairs are counted: for few queries that is no more work than rows' keys are.
FEW = 64
#: Dims, at most, whose sets are looked at; and keys a query, on average. Beyond that all pairs are counted.
DIMS, KEYS = 6, 20_000
#: A cell of a level holds 2^BITS of the level below. A level is used in a dim that has ranges of two of its cells.
BITS, LEVELS = 4, 15
#: Keys of a shuffle's task, about.
TASK_KEYS = 1_500_000


class Grid(NamedTuple):
    """rows (id, `per`, `on`, v0, v1...); cells (qid, `on`, c0, c1...: arrays of level, node and w; worth: what its ranges in a dim
    are worth at most, the largest first); the number of levels of each dim; of rows, and of queries' keys by the number of dims;
    whether no range is worth more than one."""

    rows: DataFrame
    cells: DataFrame
    levels: list[int]
    on: list[str]
    n_rows: int
    keys: dict[int, int]
    single: bool


def _shift(value: Column, level: int) -> Column:
    return F.shiftright(value, BITS * level)


def _cells(lo: Column, up: Column, w: Column, levels: int) -> Column:
    """An array of (level, node, w): the cells that make up lo to up, as large as the levels allow."""
    lo, end = lo.cast("long"), up.cast("long") + 1
    at = lambda level: (-_shift(-lo, level), _shift(end, level))
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    cell = lambda level: lambda n: F.struct(F.lit(level).alias("level"), n.alias("node"), w.alias("w"))
    parts = []
    for level in range(levels):
        (a, b), side = at(level), 1 << BITS
        nodes = run(a, b)
        if level + 1 < levels:
            c, d = at(level + 1)
            nodes = F.when(c < d, F.concat(run(a, c * side), run(d * side, b))).otherwise(nodes)
        if level:
            nodes = F.when(a < b, nodes).otherwise(F.array().cast("array<bigint>"))
        parts.append(F.transform(nodes, cell(level)))
    return F.concat(*parts)


def _apart(preds: DataFrame, on: list[str]) -> DataFrame:
    """Ranges of a query and dim that don't overlap, each with what all ranges that hold it are worth."""
    at = preds.where("lo <= up").groupBy(*on, "qid", "dim").agg(F.collect_list(F.struct(F.col("lo").cast("long").alias("lo"), F.col("up").cast("long").alias("up"), "w")).alias("r"))
    ends = F.array_sort(F.array_distinct(F.concat(F.transform("r", lambda x: x.lo), F.transform("r", lambda x: x.up + 1))))
    at = at.withColumn("ends", ends)
    zero = F.lit(0).cast(dict(preds.dtypes)["w"])
    worth = lambda lo: F.aggregate(F.filter("r", lambda x: (x.lo <= lo) & (x.up >= lo)), zero, lambda a, x: a + x.w)
    pieces = F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda lo, i: F.struct(lo.alias("lo"), (F.get("ends", i + 1) - 1).alias("up"), worth(lo).alias("w")))
    held = lambda x: F.exists("r", lambda y: (y.lo <= x.lo) & (y.up >= x.lo))
    pieces = F.when(F.size("r") == 1, F.col("r")).otherwise(F.filter(pieces, held))
    return at.select(*on, "qid", "dim", pieces.alias("pieces"))


def grid(points: DataFrame, asked: Planned, on: tuple[str, ...] = (), per: tuple[str, ...] = ()) -> Grid | None:
    """None if there are few predicates, many dims, very many keys, or rows with several values in a dim."""
    kinds = dict(asked.preds.dtypes)
    if asked.size.rows <= FEW or "n" in points.columns or kinds["lo"] not in ("tinyint", "smallint", "int", "bigint"):
        return None
    widths = asked.preds.where("lo <= up").groupBy("dim").agg(F.max(F.col("up").cast("long") - F.col("lo").cast("long")).alias("width"), F.min("w").alias("w")).orderBy("dim").limit(DIMS + 1).collect()
    if not 0 < len(widths) <= DIMS or min(r["w"] for r in widths) < 0:
        return None
    dims = [r["dim"] for r in widths]
    levels = [1 + sum(r["width"] + 1 >= 2 << (BITS * k) for k in range(1, LEVELS)) for r in widths]
    # A row's values, its points' in one line. They come from one task, mostly, and so are put together before the shuffle.
    of = lambda d: F.when(F.col("dim") == d, F.col("value"))
    found = points.where(F.col("dim").isin(dims)).groupBy("id", *per, *on)
    rows = found.agg(*(F.max(of(d)).alias(f"v{k}") for k, d in enumerate(dims)), F.greatest(*(F.count(of(d)) for d in dims), F.lit(0)).alias("most"))
    rows = materialize(rows, "rows")
    n_rows, most = rows.agg(F.count("*"), F.max("most")).first()
    if (most or 0) > 1:
        return None
    of_dim = F.element_at(F.create_map(*(x for d, n in zip(dims, levels, strict=True) for x in (F.lit(d), F.lit(n)))), F.col("dim"))
    each = _apart(asked.preds, [*on]).withColumn("levels", of_dim)
    cells = reduce(
        lambda otherwise, n: F.when(F.col("levels") == n, F.flatten(F.transform("pieces", lambda x: _cells(x.lo, x.up, x.w, n)))).otherwise(otherwise),
        sorted(set(levels)), F.lit(None),
    )
    each = each.select(*on, "qid", "dim", cells.alias("cells"))
    wide = each.groupBy(*on, "qid").agg(*(F.first(F.when(F.col("dim") == d, F.col("cells")), ignorenulls=True).alias(f"c{k}") for k, d in enumerate(dims)))
    # What ranges in so many dims are worth at most: the sum of the largest.
    worth = F.array(*(F.coalesce(F.array_max(F.transform(f"c{k}", lambda x: x.w)), F.lit(0).cast(kinds["w"])) for k in range(len(dims))))
    wide = wide.withColumn("worth", F.reverse(F.array_sort(worth)))
    cells_of = materialize(wide, "cells")
    sizes = [F.coalesce(F.size(F.col(f"c{k}").cast(_CELLS[kinds["w"]])), F.lit(0)) for k in range(len(dims))]
    sizes = [F.greatest(s, F.lit(0)).cast("long") for s in sizes]
    number = lambda c: F.sum(sum((reduce(lambda a, b: a * b, (sizes[k] for k in s)) for s in combinations(range(len(dims)), c)), F.lit(0)))
    told = cells_of.agg(F.count("*"), F.min(F.array_min("worth")), F.max(F.element_at("worth", 1)), *(number(c) for c in range(1, len(dims) + 1))).first()
    if sum(x or 0 for x in told[3:]) > KEYS * told[0]:
        return None
    return Grid(rows, cells_of, levels, [*on], n_rows, {c + 1: x or 0 for c, x in enumerate(told[3:])}, (told[2] or 1) <= 1)


_CELLS = {kind: f"array<struct<level:int,node:bigint,w:{kind}>>" for kind in ("bigint", "double", "int", "float")}


def _set(levels: Iterator[tuple[int, Column]]) -> Column:
    """A number for dims and the level of each."""
    return reduce(lambda a, b: a + b, ((level.cast("int") + 1) * (1 << 5 * k) for k, level in levels))


def _names(g: Grid, c: int) -> list[str]:
    """A key: its hash, by which it is sorted first, and what it consists of."""
    return ["h", *g.on, "s", *(f"n{k}" for k in range(c))]


def _hashed(df: DataFrame, g: Grid, c: int) -> DataFrame:
    return df.withColumn("h", F.xxhash64(*_names(g, c)[1:]))


def row_keys(g: Grid, c: int, per: tuple[str, ...] = ()) -> DataFrame:
    """Of each row, the keys of all sets of c dims."""
    keys = []
    for dims in combinations(range(len(g.levels)), c):
        for levels in product(*(range(g.levels[d]) for d in dims)):
            s = sum((level + 1) << 5 * d for d, level in zip(dims, levels, strict=True))
            nodes = (_shift(F.col(f"v{d}").cast("long"), level).alias(f"n{k}") for k, (d, level) in enumerate(zip(dims, levels, strict=True)))
            keys.append(F.struct(F.lit(s).alias("s"), *nodes))
    at = g.rows.select("id", *per, *g.on, F.inline(F.array(*keys)))
    return _hashed(at.where(" AND ".join(f"n{k} IS NOT NULL" for k in range(c))), g, c)


def query_keys(g: Grid, cells: DataFrame, c: int) -> DataFrame:
    """Of each query, the keys of all sets of c dims, and what a row with the key is worth, w."""
    parts = []
    for dims in combinations(range(len(g.levels)), c):
        at = cells.select("qid", *g.on, *(f"c{d}" for d in dims))
        for k, d in enumerate(dims):
            at = at.withColumn(f"x{k}", F.explode(f"c{d}")).drop(f"c{d}")
        x = [F.col(f"x{k}") for k in range(c)]
        w = reduce(lambda a, b: a + b, (y["w"] for y in x))
        parts.append(at.select("qid", *g.on, _set((d, y["level"]) for d, y in zip(dims, x, strict=True)).alias("s"), *(y["node"].alias(f"n{k}") for k, y in enumerate(x)), w.alias("w")))
    return _hashed(reduce(DataFrame.unionByName, parts), g, c)


def _met(g: Grid, asked: DataFrame, rows: DataFrame, c: int) -> DataFrame:
    """Queries' keys joined with rows'. Over BROADCAST_ROWS keys of queries are shuffled: Spark would judge them by the files that
    cells are in, which are a small part of what the cells' combinations take, and send them all by way of the driver."""
    return (asked if g.keys[c] <= BROADCAST_ROWS else asked.hint("merge")).join(rows, _names(g, c))


def _tasks(g: Grid, c: int) -> dict[str, str]:
    """Shuffles have tasks by the number of keys."""
    spark = g.rows.sparkSession
    sets = sum(reduce(lambda a, b: a * b, (g.levels[d] for d in dims)) for dims in combinations(range(len(g.levels)), c))
    n = (g.n_rows * sets + g.keys[c]) // TASK_KEYS
    return {"spark.sql.shuffle.partitions": str(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))}


def nearest(
    points: DataFrame, preds: DataFrame | Planned, k: int, *, exact: bool = False, weighted: bool = False, cap: int | None = None,
    descending_ids: bool = False, page: int = 1, on: tuple[str, ...] = (), per: tuple[str, ...] = (), chunk: tuple[str, ...] = (),
    by_id: bool = False,
) -> DataFrame:
    """(`per`, qid, id, cnt, rnk): the k rows with the largest counts, or a further page, as top_k(match(...), k) has them.

    Sets of all dims come first, then those of one less, and so on, until a query has k rows that are worth more than ranges
    in fewer dims can be. per: columns of points by which results are apart.
    chunk: columns of points by which rows come in chunks: the least ids are taken of each, and then of them all. Where it doesn't apply (see grid), match counts all pairs.
    """
    asked = preds if isinstance(preds, Planned) else plan(preds, exact=exact, weighted=weighted, on=on)
    g = grid(points, asked, on, (*per, *chunk))
    if g is None:
        counts = match(points, asked, cap=cap, keys=(*per, *chunk, "qid", "id"), on=on, by_id=by_id)
        counts = top_k(counts, page * k, descending_ids=descending_ids, per=(*per, *chunk, "qid")).drop("rnk", *chunk) if chunk else counts
        return top_k(counts, k, page=page, descending_ids=descending_ids, per=(*per, "qid"))
    spark, ids = points.sparkSession, F.desc("id") if descending_ids else F.asc("id")
    capped = lambda w: F.least(w, F.lit(cap).cast(dict(asked.preds.dtypes)["w"])) if cap else w
    cells, kept, first = g.cells, None, (page - 1) * k
    k *= page
    for c in range(min(len(g.levels), cap) if cap and not weighted else len(g.levels), 0, -1):
        names = _names(g, c)
        rows = row_keys(g, c, (*per, *chunk))
        for apart in ((*per, *chunk), per) if chunk else (per,):
            least = F.row_number().over(Window.partitionBy(*names, *apart).orderBy(ids))
            rows = rows.withColumn("place", least).where(F.col("place") <= k).drop("place")
        found = _met(g, query_keys(g, cells, c), rows, c).select(*per, "qid", "id", capped(F.col("w")).alias("cnt"))
        both = (found if kept is None else found.unionByName(kept.drop("rnk"))).groupBy(*per, "qid", "id").agg(F.max("cnt").alias("cnt"))
        with settings(spark, _tasks(g, c)):
            kept = materialize(top_k(both, k, descending_ids=descending_ids, per=(*per, "qid")), "kept")
        if c > 1 and not per:
            # What is left: queries without k rows that are worth more than c - 1 of their ranges.
            sure = kept.where(F.col("rnk") == k).select(F.col("qid").alias("of"), F.col("cnt").alias("sure"))
            less = F.aggregate(F.slice("worth", 1, c - 1), F.lit(0).cast(dict(asked.preds.dtypes)["w"]), lambda a, x: a + x)
            left = cells.join(sure, F.col("qid") == F.col("of"), "left").where(F.col("of").isNull() | (F.col("sure") <= less)).drop("of", "sure")
            cells = materialize(left, "left")
            if cells.isEmpty():
                break
    kept = kept.select(*per, "qid", "id", "cnt", "rnk")
    return kept.where(F.col("rnk") > first) if first else kept


def count_rows(points: DataFrame, preds: DataFrame, *, by_id: bool = False) -> DataFrame:
    """(qid, cnt, n_rows): how many rows match in so many dims, as match(...) tells when grouped by qid and cnt.

    Rows that match in all dims of a set are counted by their keys; from the sums over all sets of each size follows how many
    match in just so many (inclusion and exclusion).
    """
    asked = plan(preds)
    g = grid(points, asked)
    if g is None or not g.single:
        return match(points, asked, by_id=by_id).groupBy("qid", "cnt").agg(F.count("*").alias("n_rows"))
    spark, sums = points.sparkSession, []
    for c in range(1, len(g.levels) + 1):
        names = _names(g, c)
        found = _met(g, query_keys(g, g.cells, c), row_keys(g, c).groupBy(*names).agg(F.count("*").alias("n")), c)
        with settings(spark, _tasks(g, c)):
            sums.append(materialize(found.groupBy("qid").agg(F.sum("n").alias("n")), "sums").withColumn("c", F.lit(c)))
    just = F.explode(F.array(*(
        F.struct(F.lit(m).cast("long").alias("cnt"), (F.col("n") * F.element_at(F.array(*(F.lit((-1) ** (c - m) * comb(c, m) if c >= m else 0) for c in range(1, len(g.levels) + 1))), F.col("c"))).alias("n"))
        for m in range(1, len(g.levels) + 1)
    )))
    at = reduce(DataFrame.unionByName, sums).select("qid", just.alias("x"))
    return at.groupBy("qid", F.col("x.cnt").alias("cnt")).agg(F.sum("x.n").alias("n_rows")).where("n_rows > 0")
