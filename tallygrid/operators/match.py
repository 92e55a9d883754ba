"""Match counts: for each query and row, how many (point, predicate) pairs match."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import materialize
from .points import dealt

#: Rows (of a few numbers each) up to which predicates, dealt out to their values, are broadcast; more take a shuffled join.
BROADCAST_ROWS = 500_000
#: Blocks of queries, at most, that are asked one after the other.
BLOCKS = 32
#: Dims, at most, of rows that all_pairs takes.
DIMS = 6
#: The widest range that is dealt out to its values; wider ones are dealt out to segments of 1, 2, 4... values.
WIDEST = 1_024
#: best() works out about so many rows' counts for each result of a query, to know what is reached for certain; and marks a dim's
#: values at so many places, to tell how selective a range is.
PROBED, MARKS = 16, 256
#: Levels of segments: the widest has 2^62 values.
LEVELS = 63


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def hinted(preds: DataFrame) -> DataFrame:
    return _marked(preds, 0 if _small(preds) else BROADCAST_ROWS + 1)


class Sizes(NamedTuple):
    """What a look at the predicates says of a plan: rows; rows when dealt out to values; rows of wide ranges, and of these
    when dealt out to segments, at most."""

    rows: int
    dealt: int
    wide: int
    segments: int


def _width(lo: str = "lo", up: str = "up") -> Column:
    return F.col(up).cast("long") - F.col(lo).cast("long")


def _sizes(kind: str) -> list[Column]:
    """Sizes of predicates whose bounds are of this type; only numbers have ranges."""
    width = _width() if kind in ("tinyint", "smallint", "int", "bigint") else F.lit(0)
    wide, zero = width >= WIDEST, F.lit(0).cast("long")
    segments = F.when(wide, 2 * F.ceil(F.log2(width + F.lit(2.0))))
    return [
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.when(width.between(0, WIDEST - 1), width + 1)), zero).alias("dealt"),
        F.count_if(wide).alias("wide"), F.coalesce(F.sum(segments), zero).alias("segments"),
    ]


def planned(preds: DataFrame) -> tuple[DataFrame, Sizes]:
    """The predicates, written, and their sizes, counted from what was written."""
    at = materialize(preds, "predicates")
    return at, Sizes(*at.agg(*_sizes(dict(preds.dtypes)["lo"])).first())


def _marked(df: DataFrame, rows: int) -> DataFrame:
    """More rows are never broadcast: Spark would judge those dealt out by the small file they come from."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _shift(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def segments(lo: Column, up: Column) -> Column:
    """An array of (level, node): the fewest segments [node * 2^level, (node + 1) * 2^level) that make up lo to up; at most
    two of each level."""
    end, empty = up + 1, F.array().cast("array<struct<level:int,node:bigint>>")

    def of(level: Column) -> Column:
        a, b = -_shift(-lo, level), _shift(end, level)  # the first that begins within, and the first that doesn't end there
        node = lambda n: F.array(F.struct(level.alias("level"), n.alias("node")))
        left = F.when((a < b) & (a.bitwiseAND(F.lit(1)) == 1), node(a)).otherwise(empty)
        right = F.when((a < b) & (b.bitwiseAND(F.lit(1)) == 1), node(b - 1)).otherwise(empty)
        return F.concat(left, right)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.lit(LEVELS - 1), F.ceil(F.log2(end - lo + F.lit(1.0))).cast("int"))), of))


def met(points: DataFrame, preds: DataFrame, on: list[str], size: Sizes, exact: bool = False) -> DataFrame:
    """points joined with the predicates (qid, dim, lo, up, w, and `on`) that they match: all points' columns, qid and w.

    Points are never shuffled when predicates are few: each is looked up where it is read. Ranges that aren't wide are
    dealt out to their values, so that dim and value are join keys. Wide ones are dealt out to segments, and a point looks
    up those that hold its value, one of each level that its dim's predicates have: keys are dim, level and node.
    """
    preds = preds.select(*on, "qid", "dim", "lo", "up", "w")
    if exact:
        single = preds.where("lo <= up").select(*on, "qid", "dim", F.col("lo").alias("value"), "w")
        return points.join(_marked(single, size.rows), [*on, "dim", "value"])
    narrow = preds.where(_width().between(0, WIDEST - 1)).select(*on, "qid", "dim", F.explode(F.sequence("lo", "up")).alias("value"), "w")
    hits = points.join(_marked(narrow, size.dealt), [*on, "dim", "value"])
    if not size.wide:
        return hits
    wide = preds.where(_width() >= WIDEST).select(*on, "qid", "dim", "w", F.inline(segments(F.col("lo").cast("long"), F.col("up").cast("long"))))
    levels = wide.groupBy("dim").agg(F.sort_array(F.collect_set("level")).alias("levels"))  # at most LEVELS numbers a dim
    held = points.join(_marked(levels, size.wide), "dim").withColumn("level", F.explode("levels")).drop("levels")
    held = held.withColumn("node", _shift(F.col("value").cast("long"), F.col("level")))
    more = held.join(_marked(wide, size.segments), [*on, "dim", "level", "node"]).drop("level", "node")
    return hits.unionByName(more) if size.dealt else more


def _finish(hits: DataFrame, keys: list[str], count: Column, cap: int | None) -> DataFrame:
    cnt = F.least(count, F.lit(cap)) if cap else count
    return hits.groupBy(*keys).agg(cnt.alias("cnt"))


class Planned(NamedTuple):
    """Predicates (qid, dim, lo, up, w, and `on`) with their sizes, for one search or several."""

    preds: DataFrame
    size: Sizes
    exact: bool

    @property
    def few(self) -> bool:
        """Whether all of them, dealt out, are broadcast."""
        return self.rows <= BROADCAST_ROWS

    @property
    def rows(self) -> int:
        return self.size.rows if self.exact else max(self.size.dealt, self.size.segments)

    def blocks(self) -> list[Planned]:
        """Blocks of queries, each with few predicates; none if there would be more than BLOCKS, or if one query has too many."""
        n = -(-2 * self.rows // BROADCAST_ROWS)
        if n > BLOCKS:
            return []
        block = F.pmod(F.xxhash64("qid"), F.lit(n))
        kind = dict(self.preds.dtypes)["lo"]
        found = {r["block"]: r for r in self.preds.groupBy(block.alias("block")).agg(*_sizes(kind)).collect()}  # a row for each block
        out = [Planned(self.preds.where(block == k), Sizes(*(int(r[c]) for c in Sizes._fields)), self.exact) for k, r in sorted(found.items())]
        return out if all(x.few for x in out) else []


def plan(preds: DataFrame, *, exact: bool = False, weighted: bool = False, on: tuple[str, ...] = ()) -> Planned:
    """Equal predicates of a query summed up, written, and looked at: see match."""
    worth = F.sum("weight") if weighted else F.count("*")
    return Planned(*planned(preds.groupBy(*on, "qid", "dim", "lo", "up").agg(worth.alias("w"))), exact)


def match(
    points: DataFrame, preds: DataFrame | Planned, *, exact: bool = False, weighted: bool = False, cap: int | None = None,
    keys: tuple[str, ...] = ("qid", "id"), on: tuple[str, ...] = (), by_id: bool = False,
) -> DataFrame:
    """(qid, id, cnt), for pairs with a match.

    exact: all ranges are single values. Equal predicates of a query are summed up before they meet the points; equal
    points of a row count each, and so does a point with a column n, as often as n says. weighted: the sum of the
    predicates' weights instead of their number. cap: counts are at most this. on: further columns in which both must agree.

    Points that aren't dealt by id yet (by_id) are dealt once, so that a row's points are in one task: counts are complete
    where the points lie, and (query, row) pairs are never shuffled. That holds for predicates that are few enough to be
    broadcast. More are asked in blocks of queries, one after the other of the points that were dealt once, however
    long a list of points is; very many are joined by a shuffle of both sides, and pairs are summed up by another.
    """
    asked = preds if isinstance(preds, Planned) else plan(preds, exact=exact, weighted=weighted, on=on)
    total = F.sum(F.col("n") * F.col("w")) if "n" in points.columns else F.sum("w")
    whole = dict(asked.preds.dtypes)["w"] == "bigint"
    blocks = [asked] if asked.few else asked.blocks()
    at = dealt(points) if blocks and not by_id else points
    counts = [_finish(met(at, x.preds, list(on), x.size, x.exact), list(keys), total.cast("long") if whole else total, cap) for x in blocks or [asked]]
    return reduce(DataFrame.unionByName, counts)


def all_pairs(points: DataFrame, preds: DataFrame, *, by_id: bool = False) -> DataFrame:
    """(qid, id, cnt), for pairs with a match, as match(points, preds) has them, but no pair is made twice, and so none are summed up.

    For queries with one range in a dim at most, few dims, and ranges that aren't wide; match does all else, and rows with several
    values in a dim. A row meets a query by the first dim in which they match. Its values, and the query's other ranges, are at
    hand there and tell the count. Predicates are broadcast dim by dim, in blocks of queries if they are many.
    """
    asked = plan(preds)
    if "n" in points.columns or dict(asked.preds.dtypes)["lo"] not in ("tinyint", "smallint", "int", "bigint"):
        return match(points, asked, by_id=by_id)
    each = asked.preds.where("lo <= up")
    told = each.groupBy("dim").agg(F.count("*") == F.count_distinct("qid"), F.max(_width()), F.sum(_width() + 1)).orderBy("dim").limit(DIMS + 1).collect()
    dims, dealt_out = [r["dim"] for r in told], max((r[3] for r in told), default=0)
    n = 1 if dealt_out <= BROADCAST_ROWS else -(-2 * dealt_out // BROADCAST_ROWS)
    if not 0 < len(dims) <= DIMS or None in dims or n * len(dims) > BLOCKS or any(not single or width >= WIDEST for _, single, width, _ in told):
        return match(points, asked, by_id=by_id)
    at = points if by_id else dealt(points)
    of = lambda k, c: F.when(F.col("dim") == F.lit(dims[k]), F.col(c))
    every = range(len(dims))
    rows = at.groupBy("id").agg(*(F.max(of(k, "value")).alias(f"v{k}") for k in every), F.greatest(*(F.count(of(k, "value")) for k in every), F.lit(0)).alias("most"))
    several = (rows.agg(F.max("most")).first()[0] or 0) > 1
    sides = each.groupBy("qid").agg(*(F.max(of(k, c)).alias(f"{c}{k}") for k in every for c in ("lo", "up", "w")))
    sides = materialize(sides.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n))), "sides")
    hit = lambda k: F.coalesce(F.col(f"v{k}").between(F.col(f"lo{k}"), F.col(f"up{k}")), F.lit(False))
    out = [match(at.join(rows.where("most > 1").select("id"), "id", "left_semi"), asked)] if several else []
    rows = rows.where("most <= 1").drop("most")
    for block in range(n):
        for k in every:
            # Dealt out to its values.
            side = sides.where((F.col("block") == block) & F.col(f"w{k}").isNotNull()).drop("block").withColumn("at", F.explode(F.sequence(f"lo{k}", f"up{k}")))
            first = reduce(lambda a, b: a & b, (~hit(e) for e in range(k)), F.lit(True))
            more = (F.when(hit(e), F.col(f"w{e}")).otherwise(F.lit(0).cast("long")) for e in range(k + 1, len(dims)))
            found = rows.join(F.broadcast(side.drop(f"lo{k}", f"up{k}")), F.col(f"v{k}") == F.col("at")).where(first)
            out.append(found.select("qid", "id", reduce(lambda a, b: a + b, more, F.col(f"w{k}")).alias("cnt")))
    return reduce(DataFrame.unionByName, out)


def best(points: DataFrame, preds: DataFrame | Planned, k: int, *, weighted: bool = False, cap: int | None = None, by_id: bool = False, quantiles: DataFrame | None = None) -> DataFrame:
    """(qid, id, cnt, rnk): the k rows with the largest counts, as top_k(match(...), k) has them, without counting them all.

    For rows with one value in a dim at most, and weights that aren't negative. First, each query's most selective ranges give
    some rows, about PROBED times k, whose whole counts are worked out; the k-th of these is a count that is reached for certain. Then the least selective
    ranges are put aside, as long as all of them together are worth less than that: a row that matches none of the others
    can't be among the best, nor tie with them. Rows that match others, and may still reach it with all that was put aside, get
    the rest of their counts from their own points, which lie in the same task.

    quantiles: of the points (see stats.quantiles), if known. They only choose what is put aside; no result depends on them.
    """
    asked = preds if isinstance(preds, Planned) else plan(preds, weighted=weighted)
    at = points if by_id else dealt(points)
    if quantiles is None:
        quantiles = materialize(value_quantiles(points), "quantiles")
    share = F.size(F.filter("marks", lambda x: (x >= F.col("lo")) & (x <= F.col("up")))) + 0.5
    sized = asked.preds.join(F.broadcast(quantiles), "dim", "left")  # a row for each dim
    sized = sized.select("qid", "dim", "lo", "up", "w", F.coalesce(share * F.col("n_points") / (MARKS + 1.0), F.lit(0.0)).alias("rows"))
    order = Window.partitionBy("qid").orderBy("rows", "dim", "lo", "up")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    later = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))  # of this one and all that are less selective
    sized = materialize(sized.select("*", ((F.row_number().over(order) == 1) | (before + F.col("rows") <= PROBED * k)).alias("first"), later.alias("later")), "sized")

    def some(which: DataFrame) -> DataFrame:
        return met(at, which.select("qid", "dim", "lo", "up", "w"), [], asked.size)

    def filled(found: DataFrame, rest: DataFrame) -> DataFrame:
        """found (qid, id, cnt) with what the rest of the predicates adds."""
        points_of = at.select("id", "dim", "value")
        r = _marked(rest.select(F.col("qid").alias("q"), F.col("dim").alias("d"), "lo", "up", "w"), asked.size.rows)
        on = (F.col("qid") == F.col("q")) & (F.col("dim") == F.col("d")) & F.col("value").between(F.col("lo"), F.col("up"))
        both = found.join(points_of, "id").join(r, on, "left").groupBy("qid", "id")
        return both.agg((F.first("cnt") + F.coalesce(F.sum("w"), F.lit(0))).alias("cnt"))

    probe = some(sized.where("first")).groupBy("qid", "id").agg(F.sum("w").alias("cnt"))
    probe = filled(probe, sized.where("NOT first"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cnt")))
    reached = probe.withColumn("place", place).where(F.col("place") == k).select(F.col("qid").alias("of"), (F.least("cnt", F.lit(cap)) if cap else F.col("cnt")).alias("sure"))
    reached = materialize(reached, "sure")
    # Put aside: what is worth, with all that is less selective, less than what is reached for certain.
    parted = sized.join(_marked(reached, asked.size.rows), F.col("qid") == F.col("of"), "left").drop("of")
    aside = F.coalesce(F.col("later") < F.col("sure"), F.lit(False))
    parted = materialize(parted.withColumn("aside", aside), "parted")
    worth = parted.where("aside").groupBy("qid").agg(F.sum("w").alias("more"), F.first("sure").alias("sure"))
    found = some(parted.where("NOT aside")).groupBy("qid", "id").agg(F.sum("w").alias("cnt"))
    found = found.join(_marked(worth.withColumnRenamed("qid", "of"), asked.size.rows), F.col("qid") == F.col("of"), "left")
    names = ["qid", "id", "cnt"]
    whole = found.where("of IS NULL").select(*names)
    open_ = found.where(F.col("cnt") + F.col("more") >= F.col("sure")).select(*names)
    kinds = {r["any"] for r in parted.groupBy("qid").agg(F.bool_or("aside").alias("any")).groupBy("any").count().collect()}  # two rows
    parts = ([filled(open_, parted.where("aside"))] if True in kinds else []) + ([whole] if kinds != {True} else [])
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if cap:
        out = out.withColumn("cnt", F.least("cnt", F.lit(cap)))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cnt"), "id"))
    return out.withColumn("rnk", rank).where(F.col("rnk") <= k)


def value_quantiles(points: DataFrame) -> DataFrame:
    """(dim, n_points, marks): of each dim's values MARKS + 1 that part them about evenly."""
    return points.groupBy("dim").agg(F.count("*").alias("n_points"), F.percentile_approx("value", [k / MARKS for k in range(MARKS + 1)], 10 * MARKS).alias("marks"))


def match_subsequence(points: DataFrame, preds: DataFrame, cap: int | None = None) -> DataFrame:
    """(qid, id, offset, cnt): matches of position_points with the query laid at each offset (0 or more) of the row."""
    asked = hinted(preds.select("qid", "ord", "dim", F.col("lo").alias("value")))
    hits = points.join(asked, ["dim", "value"]).where("pos >= ord").withColumn("offset", F.col("pos") - F.col("ord"))
    return _finish(hits, ["qid", "id", "offset"], F.count("*"), cap)


def match_positions(points: DataFrame, preds: DataFrame, *, by_id: bool = False) -> DataFrame:
    """All matches themselves: (qid, id, dim, value), for each point and predicate.

    Results are many times the points, so these are dealt over tasks first, if they aren't yet (by_id): a small file is one task
    otherwise. Many predicates are asked in blocks of queries, as by match.
    """
    asked = Planned(*planned(preds.select("qid", "dim", "lo", "up", F.lit(1).alias("w"))), False)
    blocks = [asked] if asked.few else asked.blocks()
    at = dealt(points) if blocks and not by_id else points
    return reduce(DataFrame.unionByName, [met(at, x.preds, [], x.size) for x in blocks or [asked]]).select("qid", "id", "dim", "value")
