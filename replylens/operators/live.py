"""The live decision: request, evidence, the model's answer, its checks, the routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replylens.functions import policy as po
from replylens.operators import textindex
from replylens.streaming.triage import triage

HELD = "invalid_model_output"


def live_decisions(requests: DataFrame, passages: DataFrame,
                   message_id: str | Sequence[str] = "request_id",
                   intents: Sequence[str] = po.INTENTS, signals=po.risk_signals) -> DataFrame:
    """P11, T6, J9, T13, P12 and R6 on (message, history, policy, raw) rows.

    ``raw`` is the model's answer to the request. Adds ``violations`` of the request,
    ``evidence`` from ``passages``, ``output_violations`` of the answer, and ``decision``. A
    request that breaks a limit is rejected. An answer that is no record, breaks a constraint
    or cites what was not found goes to a person without a draft. Message and history come
    back redacted.
    """
    said = F.filter("history", lambda t: t["role"] == "user")
    checked = (triage(requests, (), signals).drop("verdict", "risks", "routing")
               .withColumn("_previous", F.try_element_at(said, F.lit(-1))["text"]))
    found = textindex.passage_evidence(checked, passages, message_id=message_id, previous="_previous")
    ids = F.transform("evidence", lambda e: e["id"])
    read = found.withColumn("_out", po.parse_output(F.col("raw"))).withColumn(
        "output_violations", po.output_violations(F.col("_out"), ids, intents))
    out = F.col("_out")
    routed = po.route(F.col("message"), F.col("history"), out["intent"], out["needs_human"],
                      out["handoff_reason"], out["confidence"], F.size("evidence"),
                      out["cited_doc_ids"], out["answer"], out["clarification_question"], signals)

    def without_draft(routing: str, reasons: Column) -> Column:
        return F.struct(F.lit(None).cast("string").alias("answer"), F.lit(True).alias("needs_human"),
                        F.lit(routing).alias("routing"), reasons.alias("routing_reasons"),
                        F.lit(True).alias("review_required"))

    return read.withColumn(
        "decision", F.when(F.size("violations") > 0, without_draft("rejected", F.col("violations")))
        .when(F.size("output_violations") > 0, without_draft("human_review", F.array(F.lit(HELD))))
        .otherwise(routed)).drop("_out", "_previous")
