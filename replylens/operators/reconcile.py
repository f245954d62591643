"""Answer key against policy: schema errors, deliberate exceptions, open questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.functions import policy as po


def reconcile_labels(labels: DataFrame, rules: Sequence[po.Rule] = po.DEFAULT_RULES) -> DataFrame:
    """P13, R7 per label row: ``policy``, ``errors``, ``status`` and ``pending``."""
    judged = labels.withColumn("policy", po.apply_policy(
        F.col("text"), F.coalesce("prior_messages", F.lit(0)), rules))
    return judged.withColumns({
        "errors": po.label_errors(F.col("should_escalate"), F.col("escalation_reason")),
        "status": po.label_status(F.col("policy"), F.col("should_escalate"),
                                  F.col("escalation_reason"), F.col("notes"),
                                  F.col("needs_review")),
        "pending": F.coalesce("needs_review", F.lit(False))})


def reconciliation_counts(reconciled: DataFrame) -> DataFrame:
    """One row; ``problems`` counts schema errors, unexplained rows and open reviews."""
    return (reconciled.agg(
        F.count(F.lit(1)).alias("labelled"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("schema_errors"),
        F.count_if(F.col("status") == "deliberate").alias("deliberate"),
        F.count_if(F.col("status") == "unexplained").alias("unexplained"),
        F.count_if("pending").alias("pending"))
        .withColumn("problems", F.col("schema_errors") + F.col("unexplained")
                    + F.col("pending")))


def adjudication_queue(items: DataFrame, rules: Sequence[po.Rule] = po.DEFAULT_RULES,
                       text: str = "text", intent: str = "intent") -> DataFrame:
    """The rows on which a person confirms the escalation decision."""
    return (items.withColumn("policy", po.apply_policy(F.col(text), None, rules))
            .filter(po.asks_person(F.col("policy"), F.col(intent))))


def hand_confirmed_share(items: DataFrame, rules: Sequence[po.Rule] = po.DEFAULT_RULES,
                         text: str = "text", intent: str = "intent") -> DataFrame:
    """A30."""
    asked = po.asks_person(po.apply_policy(F.col(text), None, rules), F.col(intent))
    return items.agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("confirmed"),
                     F.avg(asked.cast("int")).alias("share"))
