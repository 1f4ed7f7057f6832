"""Chat formatting with cumulative-snapshot collapse, by DataFrame functions alone.

A log that is written after every turn holds each conversation many times, as prefixes of its last state.
Every turn gets the rolling hash of its conversation up to it: sums of the hashes of (turn, place), in
three parts of 32 bits, so a running window yields all prefixes in one pass. A conversation whose whole
hash is another's proper prefix is dropped by an anti-join on (length, hash); of equal conversations the
smallest conv_id stays. Only what stays is rendered.

Turns are ordered by turn, role and hash of the text, nulls first. Defined results: a repeated row (equal
turn, role and text) counts once; null roles and texts render as empty, but are different from empty ones
in comparison; rows with a null conv_id belong to no conversation and take no part; ties between equal
conversations go to the smallest conv_id; an empty table gives an empty result; other columns are not looked at.
Hashes are computed before the shuffle, over whole texts; a rendered conversation is one row by nature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.support import materialize

#: Marks around a turn: before the role, between role and text, after the text.
MARKS = ("<|im_start|>", "\n", "<|im_end|>\n")


def _hash(seed: int):
    parts = [x for n in ("role", "text") for x in (F.col(n).isNull(), F.coalesce(F.col(n), F.lit("")))]
    return F.xxhash64(F.lit(seed), *parts)


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, p1, p2, p3, more): the hash of every conversation up to every turn; more: a further turn follows.

    turns: conv_id, turn, role, text.
    """
    hashed = turns.select("conv_id", "turn", "role", _hash(1).alias("h1"), _hash(2).alias("h2"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "h1", "h2")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    same = F.lag("h2").over(order).isNotNull()
    for n in ("turn", "role", "h1", "h2"):
        same = same & F.lag(n).over(order).eqNullSafe(F.col(n))
    placed = hashed.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("place", F.sum("new").over(so_far))
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    a, b = F.xxhash64("h1", "place"), F.xxhash64("h2", "place")
    summed = {n: F.sum(F.when(F.col("new") == 1, x).otherwise(0)).over(so_far) for n, x in (("p1", low(a)), ("p2", low(F.shiftrightunsigned(a, 32))), ("p3", low(b)))}
    return placed.withColumns(summed).withColumn("next", F.lead("new").over(order)).filter("next IS NULL OR next = 1").select("conv_id", "place", "p1", "p2", "p3", F.col("next").isNotNull().alias("more"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the maximal conversations; n_copies: conversations equal to it, itself included."""
    prefixes = materialize(turn_prefixes(turns))
    key = ["place", "p1", "p2", "p3"]
    whole = prefixes.filter("NOT more")
    within = prefixes.filter("more").select(*key).distinct()
    # equal conversations are one group before the anti-join, so a much repeated one is a single row there
    first = F.min(F.struct("conv_id"))["conv_id"]
    unique = whole.groupBy(*key).agg(first.alias("conv_id"), F.count("*").alias("n_copies"))
    return unique.join(within, key, "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, rendered."""
    c = lambda n: F.col(f"`{n}`")
    turns = conversations.select(c(conv_id).alias("conv_id"), c(turn).alias("turn"), c(role).cast("string").alias("role"), c(text).cast("string").alias("text")).filter("conv_id IS NOT NULL")
    kept = materialize(collapse(turns))
    ids = kept.select(F.col("conv_id").alias("of"), "n_turns", "n_copies")
    of = turns.join(ids, F.col("conv_id") == F.col("of"))
    item = F.struct("turn", "role", _hash(1).alias("h1"), _hash(2).alias("h2"), "text")
    listed = of.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_set(item)).alias("items"))
    empty = lambda x: F.coalesce(x, F.lit(""))
    rendered = F.array_join(F.transform("items", lambda i: F.concat(F.lit(marks[0]), empty(i["role"]), F.lit(marks[1]), empty(i["text"]), F.lit(marks[2]))), "")
    return listed.select("conv_id", "n_turns", "n_copies", rendered.alias("rendered"))
