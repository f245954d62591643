"""Arriving messages: limits, redaction, policy and risk signals, same columns as batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from replylens.functions import policy as po
from replylens.functions import text as tx


def triage(requests: DataFrame, rules: Sequence[po.Rule] = po.DEFAULT_RULES,
           signals=po.risk_signals) -> DataFrame:
    """ST1: P11, T6, R1, R5 and the content part of R6 on (message, history, policy).

    Only column functions, so a stream and a table give the same rows. A message that
    breaks a limit is kept with its violation codes and is not triaged.
    """
    text = F.concat(F.col("message"), F.lit(" "), po.user_history_text(F.col("history")))
    checked = requests.withColumn("violations", po.request_violations(
        F.col("message"), F.col("history"), F.col("policy")))
    ok = F.size("violations") == 0
    clean = checked.withColumns({
        "original": tx.uni_trim(F.col("message")),
        "message": tx.redact(tx.uni_trim(F.col("message"))),
        "history": F.transform("history", lambda t: t.withField("text", tx.redact(t["text"])))})
    return (clean.withColumn("redacted", F.col("original") != F.col("message"))
            .withColumn("verdict", F.when(ok, po.apply_policy(F.col("message"), None, rules)))
            .withColumn("risks", F.when(ok, signals(text)))
            .withColumn("routing", F.when(~ok, F.lit("rejected"))
                        .when(F.col("verdict.should_escalate") | (F.size("risks") > 0),
                              F.lit("human_review")).otherwise(F.lit("to_draft")))
            .drop("original"))


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                 by: Sequence[str] = ()) -> StreamingQuery:
    """Drive everything available through the stream into Parquet, then stop."""
    writer = (stream.writeStream.outputMode(mode).format("parquet")
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if by:
        writer = writer.partitionBy(*by)
    query = writer.start(path)
    query.awaitTermination()
    return query
