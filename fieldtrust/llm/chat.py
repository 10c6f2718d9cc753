"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions.

A logger that writes the whole conversation at each turn leaves many snapshots
that are prefixes of a later one. Rolling turn-prefix hashes identify them: the
hash of the first n turns is the sum of 64-bit hashes of (position, role, text),
twice with different seeds, so a running window sum gives every prefix of a
conversation in one pass. Anti-joins on (length, hash) drop conversations that
are a proper prefix of a longer one; of equal conversations the smallest
conv_id stays. Only those are rendered.

Turns are ordered by turn (null first), then role and text; a repeated row is a
repeated turn. Null role or text counts as empty. Rows with null conv_id form
one conversation of their own. An empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The turn markers of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rendered_turn() -> Column:
    return F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, h1, h2, whole): one row for each turn prefix."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # digests replace the texts before the shuffle
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))
    at = turns.withColumn("n", F.row_number().over(order))
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "n", "role", "text").cast("decimal(38,0)")).over(running)
    return at.select("conv_id", "n", part(1).alias("h1"), part(2).alias("h2"), F.lead("n").over(order).isNull().alias("whole"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that are no prefix of
    another; equal ones are counted and the smallest id stands for them."""
    rows = prefixes(conversations)
    inner = rows.where("not whole").select("n", "h1", "h2").distinct()
    whole = rows.where("whole").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    keep = maximal(conversations)
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    shown = turns.join(keep.select(F.col("conv_id").alias("id"), "n_turns", "n_copies"), F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    item = F.struct("turn", "role", F.sha2("text", 256).alias("h"), rendered_turn().alias("shown"))
    return shown.groupBy("conv_id", "n_turns", "n_copies").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["shown"]), "").alias("rendered")
    )
