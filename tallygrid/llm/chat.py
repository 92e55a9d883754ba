"""Chat formatting for several speakers: a dialogue is rendered once from the place of each participant.

In a rendering the speaker's turns are the assistant's, all others are a user's, by name, and system turns stay; a mask
marks what the assistant says. Dialogues of few turns are put together by one shuffle. Long ones come in parts of a bounded
number of turns, so that no task ever holds a whole one: turns are numbered within ranges of the sorted table, and the
ranges' sizes are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import broadcast_if_small, materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns in a part of a rendering.
TURNS = 64
#: Conversations of several parts that are broadcast, by their ids; more take a shuffled join.
LONG_ROWS = 500_000
#: What a turn without a role is called.
NOBODY = "unknown"


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text) with seq, from 1 in each conversation, by turn (nulls last), role and text.

    The table is sorted by ranges, which split a conversation of any size; what stands before a range is added.
    """
    order = ["conv", F.asc_nulls_last("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"), "tie"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).withColumn("range", F.spark_partition_id())
    at = materialize(at, "turns")
    sizes = at.groupBy("conv", "range").count()
    before = sizes.select("conv", "range", (F.sum("count").over(Window.partitionBy("conv").orderBy("range")) - F.col("count")).alias("before"))
    own = at.withColumn("own", F.row_number().over(Window.partitionBy("conv", "range").orderBy(*order[1:])))
    own, before = own.alias("a"), before.alias("b")
    joined = own.join(before, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.range") == F.col("b.range")))
    return joined.select("a.conv", "a.role", "a.text", (F.col("own") + F.col("before")).alias("seq"))


def header(role: Column, speaker: Column, system: Sequence[str]) -> Column:
    name = F.when(role == speaker, "assistant").when(role.isin(*system), "system").otherwise(F.concat(F.lit("user name="), F.coalesce(role, F.lit(NOBODY))))
    return F.concat(F.lit(OPEN), name, F.lit("\n"))


def perspectives(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: Sequence[str] = ("system",), turns: int = TURNS
) -> DataFrame:
    """(conv_col, speaker, part, n_turns, n_own, text, spans): each dialogue from the place of each of its participants.

    Participants are the distinct roles, but for those in `system`. A turn reads <|im_start|>assistant, user name=ROLE or
    system, a line break, its text, <|im_end|> and a line break. spans has the assistant's texts with their end marks, as
    start-end in characters of the part's text, joined by commas. Parts have `turns` turns, the last one fewer; parts in
    order, joined, are the whole rendering: only the first has a leading system turn. Roles and texts go in as they are,
    also where they hold such marks or line breaks; spans, not marks, say whose a text is.

    Turns are ordered by turn, role and text; null turns come last. A null text is empty; a turn with a null role is a
    user's named unknown and no participant. Rows with a null conversation are one conversation. Repeated rows are
    repeated turns. A conversation of system turns only has no participant and no row; nor has an empty table. Other
    columns are ignored.
    """
    at = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    takes_part = lambda r: r.isNotNull() & ~r.isin(*system)
    # Most dialogues are one part: their texts are shuffled once, and all else follows from the part.
    long = materialize(at.groupBy("conv").count().where(F.col("count") > turns).select(F.col("conv").alias("of")), "long-conversations")
    none, long = long.isEmpty(), broadcast_if_small(long, LONG_ROWS)
    same = F.col("conv").eqNullSafe(F.col("of"))
    said = F.transform(F.sort_array(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    whole = (at if none else at.join(long, same, "left_anti")).groupBy("conv").agg(said.alias("turns"))
    both = whole.select("conv", F.lit(0).cast("long").alias("part"), "turns", F.explode(F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), takes_part))).alias("speaker"))
    if not none:
        rest = at.join(long, same, "left_semi")
        who = rest.where(takes_part(F.col("role"))).select("conv", F.col("role").alias("speaker")).distinct()
        part = F.floor((F.col("seq") - 1) / turns).cast("long")
        parts = numbered(rest).groupBy("conv", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text"))).alias("turns"))
        parts = parts.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
        both = both.unionByName(parts.alias("p").join(who.alias("w"), F.col("p.conv").eqNullSafe(F.col("w.conv"))).select("p.conv", "p.part", "p.turns", "w.speaker"))

    speaker = F.col("speaker")
    pieces = F.transform("turns", lambda t: F.struct((t.role.eqNullSafe(speaker)).alias("own"), header(t.role, speaker, system).alias("head"), F.concat(t.text, F.lit(CLOSE)).alias("body")))
    both = both.select("conv", "speaker", "part", pieces.alias("pieces"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def mark(s: Column, p: Column) -> Column:
        a = s["at"] + F.length(p["head"])
        b = a + F.length(p["body"])
        span = F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
        return F.struct((b + 1).alias("at"), F.when(p["own"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return both.select(
        F.col("conv").alias(conv_col), "speaker", "part", F.size("pieces").cast("long").alias("n_turns"), F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.array_join(F.aggregate("pieces", start, mark)["spans"], ",").alias("spans"),
    )
