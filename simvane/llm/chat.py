"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation several times, each time with some turns more. A
rolling hash over its turns gives every prefix of every conversation a key; an
anti-join of whole conversations against proper prefixes drops those that
another one continues, and of equal conversations the smallest conv_id stays. What
is left is rendered, one string for each conversation.

Turns of a conversation stand in the order of (turn, role, text), nulls first. The
key of a prefix is its length and the XOR of two hashes, of 64 bits each, of its
turns mixed with their places.

Plan: DataFrame functions only. Turns are shuffled by conversation once for the
rolling hash and once to render what is kept. Equal prefixes are made one row
with partial aggregation before the anti-join, so a first turn or a conversation
that many logs share is one row on either side.

Defined results: a null conv_id takes part as one conversation of its own; a null
role or text is told apart from an empty one in keys and rendered as empty; rows
that repeat a turn count as further turns; an empty table gives an empty result;
other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """One row for each prefix of each conversation: conv_id, length, h1, h2, total (turns of the conversation)."""
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    said = [F.coalesce(F.length(c), F.lit(-1)) for c in ("role", "text")]
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("length", F.row_number().over(order).cast("long"))
    rows = rows.select(
        "conv_id",
        "length",
        F.xxhash64(F.lit(1), "length", *said, "role", "text").alias("a"),
        F.xxhash64(F.lit(2), "text", "role", *said, "length").alias("b"),
    )
    so_far = conv.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv_id", "length", F.bit_xor("a").over(so_far).alias("h1"), F.bit_xor("b").over(so_far).alias("h2"), F.count("*").over(conv).alias("total"))


def maximal(turns: DataFrame) -> DataFrame:
    """One row for each conversation that no longer one continues, the smallest conv_id of equal ones: conv_id, n_turns, n_copies."""
    every = prefixes(turns)
    key = ["length", "h1", "h2"]
    whole = every.filter("length = total").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = every.filter("length < total").groupBy(*key).agg(F.count("*").alias("n"))
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("length").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_copies, rendered."""
    kept = maximal(turns)
    said = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text").join(kept, F.col("conv").eqNullSafe(F.col("conv_id")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", said.alias("said"))))
    grouped = rows.groupBy("conv").agg(ordered.alias("turns"), F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"))
    return grouped.select(F.col("conv").alias("conv_id"), "n_turns", "n_copies", F.array_join(F.transform("turns", lambda x: x["said"]), "").alias("rendered"))
