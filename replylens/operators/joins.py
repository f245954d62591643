"""Set and join operators on keyed tables: splits, work left, cases, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("dev", "test", "all")


def of_split(df: DataFrame, split: str) -> DataFrame:
    """P8."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    return df if split == "all" else df.filter(F.col("split") == split)


def only_split(df: DataFrame, split: str) -> DataFrame:
    """A row of any other split stops the job; fitting code reads through this."""
    return df.filter(F.when(F.col("split") == split, True).otherwise(F.raise_error(
        F.concat(F.lit(f"expected only {split} rows, found "),
                 F.coalesce("split", F.lit("none")))).cast("boolean")))


def is_done() -> Column:
    """P10: an error is not a result."""
    return F.nullif(F.col("error"), F.lit("")).isNull()


def usable(results: DataFrame) -> DataFrame:
    """P10."""
    return results.filter(is_done())


def work_remaining(items: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Items without a finished result; repeated attempts count once."""
    return items.join(usable(results).select(key).distinct(), key, "left_anti")


def without_texts(runs: DataFrame) -> DataFrame:
    """Runs with a ``replied`` flag in place of the reply text."""
    return runs.withColumn("replied", F.nullif("reply", F.lit("")).isNotNull()).drop("reply")


def graded(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """Predictions for ids of the answer key, with the key's columns."""
    return runs.join(gold, "id")


def rater_pairs(first: DataFrame, second: DataFrame, dims: list[str],
                names: tuple[str, str] = ("human", "judge")) -> DataFrame:
    """Ids both raters finished, with one column per rater and dimension."""
    a = usable(first).select("id", *[F.col(d).alias(f"{names[0]}_{d}") for d in dims])
    b = usable(second).select("id", *[F.col(d).alias(f"{names[1]}_{d}") for d in dims])
    return a.join(b, "id")


def with_context(rows: DataFrame, context: DataFrame, key: str = "id") -> DataFrame:
    """Optional columns beside each row."""
    return rows.join(context, key, "left")


def common_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """U3."""
    return a.select(key).intersect(b.select(key))


def missing_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """U4."""
    return a.select(key).distinct().subtract(b.select(key))


def progress(wanted: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Wanted ids by state. ``results`` holds the latest attempt per id."""
    state = results.select(key, F.when(is_done(), "done").otherwise("errored").alias("state"))
    return (wanted.select(key).distinct().join(state, key, "left")
            .agg(F.count(F.lit(1)).alias("wanted"),
                 F.count_if(F.col("state") == "done").alias("done"),
                 F.count_if(F.col("state") == "errored").alias("errored")))


def replay_cases(gold: DataFrame, runs: DataFrame, evidence: DataFrame, judge: DataFrame,
                 human: DataFrame) -> DataFrame:
    """Prediction, expectation, evidence with cited flags, and both ratings per id.

    ``evidence`` has (id, evidence array); a run cites evidence by position.
    """
    cited = F.transform(F.col("evidence"), lambda e: e.withField(
        "cited", F.array_contains(F.col("evidence_ids"), e["pos"].cast("long"))))
    return (runs.join(gold, "id")
            .join(evidence, "id", "left")
            .join(judge.select("id", F.col("acceptable").alias("judge_acceptable")), "id", "left")
            .join(human.select("id", F.col("acceptable").alias("human_acceptable")), "id", "left")
            .withColumn("evidence", cited))


def case_flags(cases: DataFrame) -> DataFrame:
    """The four listing modes as columns."""
    expected = F.coalesce(F.col("should_escalate"), F.lit(False))
    sent = F.coalesce(F.col("escalated"), F.lit(False))
    return cases.withColumns({
        "is_missed": expected & ~sent, "is_escalated": sent,
        "is_wrong": ~F.col("pred").eqNullSafe(F.col("gold")),
        "is_disagreement": F.coalesce(
            F.col("judge_acceptable") != F.col("human_acceptable"), F.lit(False))})


def search_cases(cases: DataFrame, needle: str = "", mode: str = "all") -> DataFrame:
    """Literal search over text, intent and id, within one listing mode."""
    flags = {"missed": "is_missed", "escalated": "is_escalated", "wrong": "is_wrong",
             "disagreement": "is_disagreement"}
    out = case_flags(cases)
    if mode != "all":
        out = out.filter(F.col(flags[mode]))
    if needle.strip():
        hay = F.lower(F.concat_ws(" ", "text", "pred", F.col("id").cast("string")))
        out = out.filter(F.contains(hay, F.lit(needle.lower().strip())))
    return out
