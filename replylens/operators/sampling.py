"""Seeded, stratified and budgeted samples.

Every draw orders rows by ``md5(seed:id)``: repeatable on any partitioning, uniform, and
with the id as last key. A large frame is never sorted whole: its md5 prefixes are
counted first, which bounds the rows that can be in the sample.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replylens.functions import text as tx
from replylens.functions.policy import INTENTS

SEED = 20260910
# Sizes of the evaluation set.
N_TOTAL, N_RANDOM, N_HARD, PER_CLASS, DEV_SIZE = 200, 140, 15, 20, 60
N_RELABEL, N_RATED = 50, 60


def draw_key(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _prefix(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("int")


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = SEED) -> DataFrame:
    """The ``n`` rows with the smallest draw key.

    The 65,536 possible key prefixes are counted, and only rows up to the prefix in which
    the n-th row falls are sorted: about n plus one prefix worth of rows.
    """
    key = draw_key(id_col, seed)
    counts = df.select(_prefix(key).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    reached = F.sum("c").over(Window.orderBy("p").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    cutoff = (counts.select("p", reached.alias("upto"))
              .agg(F.coalesce(F.min(F.when(F.col("upto") >= n, F.col("p"))), F.lit(65536))))
    return (df.filter(_prefix(key) <= cutoff.scalar())
            .orderBy(key, F.col(id_col)).limit(n))


def relabel_subset(df: DataFrame, id_col: str, n: int = N_RELABEL, seed: int = SEED) -> DataFrame:
    """The same rows every time, in an order unrelated to the first pass."""
    return seeded_sample(df, id_col, n, seed + 1)


def rating_subset(df: DataFrame, id_col: str, n: int = N_RATED, seed: int = SEED) -> DataFrame:
    """The rows a person rates."""
    return seeded_sample(df, id_col, n, seed + 2)


def per_class_sample(df: DataFrame, cls: str, id_col: str, n: int = 2,
                     seed: int = SEED) -> DataFrame:
    """Up to ``n`` rows of every class. The rank limit is applied before the shuffle."""
    w = Window.partitionBy(cls).orderBy(draw_key(id_col, seed), F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def split_and_sequence(pool: DataFrame, id_col: str = "id", dev_size: int = DEV_SIZE,
                       seed: int = SEED) -> DataFrame:
    """Shuffle a chosen pool, number it, and cut dev from test.

    The pool is an evaluation set of fixed size, which is why one ordering of it is fine.
    """
    w = Window.orderBy(draw_key(id_col, seed), F.col(id_col))
    return (pool.withColumn("seq", F.row_number().over(w))
            .withColumn("split", F.when(F.col("seq") <= dev_size, "dev").otherwise("test")))


def random_stratum(df: DataFrame, id_col: str, n: int = N_RANDOM, seed: int = SEED) -> DataFrame:
    """Rows at natural prevalence."""
    return seeded_sample(df, id_col, n, seed).withColumn("stratum", F.lit("random"))


def without(df: DataFrame, chosen: DataFrame, id_col: str) -> DataFrame:
    """Rows no earlier stratum took."""
    return df.join(chosen.select(id_col).distinct(), id_col, "left_anti")


def topup_plan(have: DataFrame, available: DataFrame, budget: int, per_class: int = PER_CLASS,
               classes: Sequence[str] = INTENTS, label: str = "label") -> DataFrame:
    """How many rows each class gets, rarest class first, until the budget is gone.

    ``have`` and ``available`` are (label, n) counts. A running sum over the class list
    gives the same result as filling the classes one by one.
    """
    spark = have.sparkSession
    domain = spark.createDataFrame([(c, i) for i, c in enumerate(classes)], f"{label} string, ord int")

    def listed(counts: DataFrame, name: str) -> DataFrame:
        # At most one row per class of the fixed list.
        return F.broadcast(counts.filter(F.col(label).isin(*classes))
                           .select(label, F.col("n").alias(name)))

    plan = (domain.join(listed(have, "have"), label, "left")
            .join(listed(available, "avail"), label, "left")
            .fillna(0, ["have", "avail"])
            .withColumn("need", F.greatest(
                F.least(F.lit(per_class) - F.col("have"), F.col("avail")), F.lit(0))))
    before = Window.orderBy("have", "ord").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("need").over(before), F.lit(0))
    return plan.withColumn("take", F.greatest(
        F.least(F.col("need"), F.lit(budget) - spent), F.lit(0)).cast("long"))


def topup_stratum(df: DataFrame, id_col: str, label: str, chosen: DataFrame, budget: int,
                  per_class: int = PER_CLASS, classes: Sequence[str] = INTENTS,
                  seed: int = SEED) -> DataFrame:
    """Draw the rows of ``topup_plan`` from those not chosen yet."""
    rest = without(df.filter(F.col(label).isin(*classes)), chosen, id_col)
    have = chosen.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    avail = rest.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    plan = topup_plan(have, avail, budget, per_class, classes, label)
    w = Window.partitionBy(label).orderBy(draw_key(id_col, seed), F.col(id_col))
    ranked = rest.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_class)
    return (ranked.join(F.broadcast(plan.select(label, "take")), label)
            .filter(F.col("_rn") <= F.col("take"))
            .drop("_rn", "take").withColumn("stratum", F.lit("topup")))


def _round_robin(n: int):
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        order = (pdf.groupby("kind", as_index=False)["score"].max()
                 .sort_values(["score", "kind"], ascending=[False, True])["kind"])
        queues = {k: pdf[pdf["kind"] == k].sort_values(["score", "_draw", "_id"],
                                                       ascending=[False, True, True])
                  .index.tolist() for k in order}
        seen, taken = set(), []
        while len(taken) < n and any(queues.values()):
            for kind in order:
                queue = queues[kind]
                while queue and pdf.at[queue[0], "_key"] in seen:
                    queue.pop(0)
                if queue and len(taken) < n:
                    row = queue.pop(0)
                    seen.add(pdf.at[row, "_key"])
                    taken.append(row)
        out = pdf.loc[taken].drop(columns="_all")
        out["pick"] = range(1, len(out) + 1)
        return out
    return pick


def hard_stratum(df: DataFrame, id_col: str, text: str, n: int = N_HARD, seed: int = SEED,
                 signals: dict[str, str] | None = None) -> DataFrame:
    """Awkward messages spread across kinds, no two with the same near-duplicate key.

    The final pick takes at most n rows of a kind and skips at most n - 1 keys taken by
    other kinds, so the best 2n - 1 distinct keys per kind hold every possible pick. That
    bounded table (seven kinds) is the only thing the greedy step sees.
    """
    slim = df.select(F.col(id_col).cast("string").alias("_id"), F.col(text).alias("_text"))
    # An exploded optional value drops the ordinary messages; a filter would be pushed
    # below the scoring and score every message twice.
    scored = (tx.add_hardness(slim, "_text", "_h", signals)
              .select("_id", "_text", F.explode(F.when(
                  F.col("_h.score") > 0, F.array("_h"))).alias("h"))
              .select("_id", F.col("h.score").alias("score"), F.col("h.kind").alias("kind"),
                      F.col("h.reason").alias("reason"), draw_key("_id", seed).alias("_draw"),
                      F.md5(tx.near_dup_key(F.col("_text"))).alias("_key")))
    best = scored.groupBy("kind", "_key").agg(F.min(F.struct(
        (-F.col("score")).alias("neg"), "_draw", "_id", "reason")).alias("b"))
    rank = Window.partitionBy("kind").orderBy("b.neg", "b._draw", "b._id")
    short = (best.withColumn("_rn", F.row_number().over(rank))
             .filter(F.col("_rn") <= 2 * n - 1)
             .select("kind", "_key", (-F.col("b.neg")).alias("score"), "b._draw", "b._id",
                     "b.reason", F.lit(1).alias("_all")))
    schema = ("kind string, _key string, score int, _draw string, _id string, reason string, "
              "pick long")
    picked = short.groupBy("_all").applyInPandas(_round_robin(n), schema)
    return picked.select(F.col("_id").alias(id_col), "kind", "score",
                         F.col("reason").alias("hard_reason"), "pick",
                         F.lit("hard").alias("stratum"))


def evaluation_pool(df: DataFrame, id_col: str, text: str, label: str, total: int = N_TOTAL,
                    n_random: int = N_RANDOM, n_hard: int = N_HARD, per_class: int = PER_CLASS,
                    dev_size: int = DEV_SIZE, classes: Sequence[str] = INTENTS,
                    signals: dict[str, str] | None = None, seed: int = SEED,
                    keep=lambda frame, name: frame) -> DataFrame:
    """The three disjoint strata as one pool with sequence and split.

    ``keep`` may store an intermediate frame (see ``session.materialise``), because each
    stratum is needed again to exclude its rows from the next one.
    """
    base = df.filter(tx.has_text(F.col(text))).withColumn(id_col, F.col(id_col).cast("string"))
    first = keep(random_stratum(base, id_col, n_random, seed).withColumn("hard_reason", F.lit("")),
                 "random")
    hard_ids = hard_stratum(without(base, first, id_col), id_col, text, n_hard, seed, signals)
    second = keep(base.join(F.broadcast(hard_ids.select(id_col, "stratum", "hard_reason")), id_col)
                  .select(*first.columns), "hard")
    chosen = first.unionByName(second)
    budget = total - chosen.count()
    third = topup_stratum(base, id_col, label, chosen, max(budget, 0), per_class, classes, seed)
    pool = chosen.unionByName(third.withColumn("hard_reason", F.lit("")))
    return (split_and_sequence(pool, id_col, dev_size, seed)
            .withColumn("is_hard", F.col("stratum") == "hard"))
