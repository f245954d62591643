"""A check against labels written by someone else: approaches scored on a (text, category) table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.functions import stats as st
from replylens.operators import metrics as me
from replylens.operators.gramclassifier import classify_text, fit_text_classifier
from replylens.operators.sampling import SEED, per_class_sample
from replylens.operators.scoring import Scorer, score_batches
from replylens.session import materialise

PER_CATEGORY = 2


def scored_sample(test: DataFrame, scorer: Scorer, per_category: int = PER_CATEGORY, seed: int = SEED) -> DataFrame:
    """A scorer's answers on up to ``per_category`` texts of every category: (gold, pred, error).

    Every category is there, however rare. A text at which the scorer raises fails alone.
    """
    drawn = per_class_sample(test, "category", "text", per_category, seed)
    return score_batches(drawn, scorer, "pred string", halve=True).select(F.col("category").alias("gold"), "pred", "error")


def classified(train: DataFrame, test: DataFrame, min_df: float = 2.0) -> DataFrame:
    """M2: the text classifier, fitted on ``train``, on all of ``test``: (gold, pred, error).

    A ``train`` that names its ``split`` must be dev rows only.
    """
    rows = train.filter("text is not null and category is not null").withColumnRenamed("category", "label")
    if "split" not in rows.columns:
        rows = rows.withColumn("split", F.lit("dev"))
    model = fit_text_classifier(rows, min_df=min_df)
    return classify_text(model, test).select(F.col("category").alias("gold"), "pred",
                                             F.lit(None).cast("string").alias("error"))


def external_check(train: DataFrame, test: DataFrame, scorers: Mapping[str, Scorer] | None = None,
                   per_category: int = PER_CATEGORY, min_df: float = 2.0) -> DataFrame:
    """IO10, M1, M2: (approach, gold, pred, error) of the text classifier and of every scorer, stored once.

    Rows of ``test`` without a category are left out: there is nothing to hold them against.
    """
    test = test.filter("category is not null")
    scored = classified(train, test, min_df).withColumn("approach", F.lit("classifier"))
    for name, scorer in (scorers or {}).items():
        scored = scored.unionByName(scored_sample(test, scorer, per_category).withColumn("approach", F.lit(name)))
    return materialise(scored.select("approach", "gold", "pred", "error"), "checked")


def observed_classes(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of every label that a group's rows or predictions name."""
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("gold").alias("label"), hit.alias("tp"), zero.alias("fp"), (F.col("n") - hit).alias("fn")),
                    F.struct(F.col("pred").alias("label"), zero.alias("tp"), (F.col("n") - hit).alias("fp"), zero.alias("fn")))
    table = (counts.select(*by, F.explode(sides).alias("s")).select(*by, "s.*").groupBy(*by, "label")
             .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (table.withColumns({"support": tp + fn, "precision": st.ratio(tp, tp + fp), "recall": st.ratio(tp, tp + fn)})
            .withColumn("f1", st.f1(F.col("precision"), F.col("recall"))))


def check_summary(scored: DataFrame) -> DataFrame:
    """One row per approach; rows without a prediction are errors and are not graded.

    ``off_taxonomy`` predictions name no category of the approach's rows; they are graded as wrong. F1 is averaged
    over all labels on either side.
    """
    by = ["approach"]
    counts = me.confusion_counts(scored, by=by)
    asked = scored.groupBy(*by).agg(F.count_if(F.col("pred").isNull()).alias("errors"))
    known = scored.select(*by, F.col("gold").alias("pred")).distinct()
    off = counts.join(known, [*by, "pred"], "left_anti").groupBy(*by).agg(F.sum("n").alias("off_taxonomy"))
    classes = counts.groupBy(*by).agg(F.countDistinct("gold").alias("classes"))
    f1 = me.averaged_f1(observed_classes(counts, by), by).select(*by, "macro_f1")
    right = me.accuracy(counts, by).withColumnsRenamed({"acc_n": "n", "acc_correct": "correct"})
    table = asked
    for part in (right, classes, off, f1):
        table = table.join(part, by, "left")
    whole = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "correct", "classes", "off_taxonomy")}
    return me.with_interval(table.withColumns(whole), "correct", "n").drop("point")


def check_confusions(scored: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent confusions of every approach."""
    return me.confused_pairs(me.confusion_counts(scored, by=["approach"]), top, ["approach"])
