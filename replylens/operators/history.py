"""Running state inside a conversation, safe for one conversation of any length.

A plain window over a conversation puts all its rows in one task. Here rows are grouped
by (conversation, block of ``width`` positions); each block is solved on its own and
only one summary row per block is carried along the conversation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def _carried(local: DataFrame, keys: Sequence[str], summary: Column, carry: Column,
             name: str) -> DataFrame:
    """One row per block after the first: what earlier blocks of the same key add up to."""
    along = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    blocks = local.groupBy(*keys, "_block").agg(summary.alias("_summary"))
    return (blocks.select(*keys, "_block", carry.over(along).alias(name),
                          F.lag("_block").over(Window.partitionBy(*keys).orderBy("_block"))
                          .alias("_before"))
            .filter(F.col("_before").isNotNull()).drop("_before"))


def running_count(df: DataFrame, keys: Sequence[str], order: str, condition: Column,
                  name: str, width: int = WIDTH) -> DataFrame:
    """Earlier rows of the same key for which ``condition`` holds.

    ``order`` is an integer column, unique within a key (a turn number, an epoch time).
    """
    block = F.floor(F.col(order) / width)
    before = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    local = (df.withColumns({"_block": block, "_hit": condition.cast("int")})
             .withColumn("_local", F.coalesce(F.sum("_hit").over(before), F.lit(0))))
    carried = _carried(local, keys, F.sum("_hit"), F.sum("_summary"), "_carry")
    return (local.join(carried, [*keys, "_block"], "left")
            .withColumn(name, F.col("_local") + F.coalesce("_carry", F.lit(0)))
            .drop("_block", "_hit", "_local", "_carry"))


def prior_messages(turns: DataFrame, keys: Sequence[str] = ("conv_id",), order: str = "turn",
                   width: int = WIDTH) -> DataFrame:
    """How many customer messages precede each row of its conversation."""
    return running_count(turns, keys, order, F.col("role") == "user", "prior_messages", width)


def last_user_text(turns: DataFrame, keys: Sequence[str] = ("conv_id",), order: str = "turn",
                   width: int = WIDTH) -> DataFrame:
    """The latest customer text before each row."""
    said = F.when(F.col("role") == "user", F.col("text"))
    before = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    local = (turns.withColumn("_block", F.floor(F.col(order) / width))
             .withColumn("_local", F.last(said, ignorenulls=True).over(before)))
    latest = F.max_by(F.col("text"), F.when(F.col("role") == "user", F.col(order)))
    carried = _carried(local, keys, latest, F.last("_summary", ignorenulls=True), "_carry")
    return (local.join(carried, [*keys, "_block"], "left")
            .withColumn("previous_user_text", F.coalesce("_local", "_carry"))
            .drop("_block", "_local", "_carry"))


def recent_turns(turns: DataFrame, n: int = 4, keys: Sequence[str] = ("conv_id",),
                 order: str = "turn", width: int = WIDTH) -> DataFrame:
    """The ``n`` turns before each row, oldest first, as array<struct<role, text>>.

    Rows get a dense position, then each block borrows the last ``n`` rows of the block
    before it, so no block ever needs more than ``width + n`` rows.
    """
    placed = running_count(turns, keys, order, F.lit(True), "_pos", width)
    block = F.floor(F.col("_pos") / width)
    borrowed = F.when(F.col("_pos") % width >= width - n, F.array(block, block + 1)) \
        .otherwise(F.array(block))
    spread = (placed.withColumn("_home", block)
              .withColumn("_block", F.explode(borrowed)))
    back = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-n, -1)
    return (spread.withColumn("history", F.collect_list(F.struct("role", "text")).over(back))
            .filter(F.col("_home") == F.col("_block"))
            .drop("_pos", "_home", "_block"))
