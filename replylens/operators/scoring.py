"""Batch scoring with a pluggable scorer, text vectors, and baselines."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replylens.functions import policy as po
from replylens.functions import text as tx
from replylens.functions import vectors as vx
from replylens.operators.joins import work_remaining
from replylens.sources import results

Scorer = Callable[[pd.DataFrame], pd.DataFrame]
ERROR_CHARS = 300

VERDICT_FIELDS = T.StructType([T.StructField(f, T.BooleanType()) for f in (
    "grounded", "addresses_ask", "no_overpromise", "tone_ok")])


def score_batches(items: DataFrame, scorer: Scorer, fields: T.StructType | str,
                  halve: bool = False) -> DataFrame:
    """M1, M5: run ``scorer`` on Arrow batches and keep going past bad rows.

    ``scorer`` gets a pandas batch and returns the ``fields`` columns, row for row, and an
    ``error`` column for rows it could not score; every row is scored once. If it raises,
    all rows of the batch carry the error text, or with ``halve`` the batch is halved until
    only the offending rows do, which scores the others again. A limit on calls belongs in
    the scorer or in the resources of its tasks: partitions stay as the table has them.
    Store the result before using it twice, or the scorer runs twice.
    """
    if isinstance(fields, str):
        fields = T.StructType.fromDDL(fields)
    names = fields.fieldNames()
    extra = T.StructType([T.StructField("latency_s", T.DoubleType()),
                          T.StructField("error", T.StringType())])
    out = T.StructType(items.schema.fields + fields.fields + extra.fields)

    def timed(pdf: pd.DataFrame) -> pd.DataFrame:
        started = time.perf_counter()
        got = scorer(pdf).reset_index(drop=True)
        if len(got) != len(pdf):
            raise ValueError(f"scorer returned {len(got)} rows for {len(pdf)}")
        error = got["error"] if "error" in got else None
        return got[names].assign(
            latency_s=(time.perf_counter() - started) / max(len(pdf), 1), error=error)

    def attempt(pdf: pd.DataFrame) -> list[pd.DataFrame]:
        try:
            return [timed(pdf.reset_index(drop=True))]
        except Exception as exc:  # a bad row is a result to record, not a reason to stop
            if halve and len(pdf) > 1:
                half = len(pdf) // 2
                return attempt(pdf.iloc[:half]) + attempt(pdf.iloc[half:])
            n_rows = len(pdf)
            return [pd.DataFrame({**{n: [None] * n_rows for n in names}, "latency_s": [0.0] * n_rows,
                                  "error": [f"{type(exc).__name__}: {exc}"[:ERROR_CHARS]] * n_rows})]

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            parts = attempt(pdf)
            got = parts[0] if len(parts) == 1 else pd.concat(
                [p.astype(object) for p in parts], ignore_index=True)
            yield pd.concat([pdf, got], axis=1)[out.fieldNames()]

    return items.mapInPandas(run, out)


def score_remaining(items: DataFrame, path: str, config: str, run_ts: int, scorer: Scorer,
                    fields: T.StructType | str, halve: bool = True) -> None:
    """J3, M1, IO6: score what earlier runs of ``config`` have not finished, and store it.

    Only items without a stored result are scored, so a lost job or a failed row costs its
    own calls again and no others. A run repeated under its own number replaces itself:
    its earlier attempts do not count as done. A row at which the scorer raises fails alone: its batch is
    halved until the others have their results; without ``halve`` the batch would fail as one,
    in every later run again.
    """
    spark = items.sparkSession
    kinds = T.StructType([*score_batches(items, scorer, fields).schema.fields,
                          T.StructField("config", T.StringType()),
                          T.StructField("run_ts", T.LongType())])
    others = results.attempts(spark, path, kinds).filter(
        (F.col("config") == config) & (F.col("run_ts") != run_ts))
    scored = score_batches(work_remaining(items, others), scorer, fields, halve)
    results.append_results(scored.withColumn("config", F.lit(config)), path, run_ts)


def judged(scored: DataFrame) -> DataFrame:
    """Verdicts with the derived ``acceptable``; an errored row has none."""
    ok = po.acceptable(F.col("grounded"), F.col("addresses_ask"), F.col("no_overpromise"))
    return scored.withColumn("acceptable", F.when(F.col("error").isNull(), ok))


# ---- text vectors ---------------------------------------------------------------------

def encode_text(items: DataFrame, encoder: Callable[[pd.Series], list], text: str = "text",
                vector: str = "vector") -> DataFrame:
    """M3: unit vectors from a caller-supplied encoder, one call per Arrow batch.

    ``encoder`` gets the texts of a batch and returns one vector per text; a model it needs
    is loaded once per worker if it keeps it in module scope.
    """
    out = T.StructType([*items.schema.fields,
                        T.StructField(vector, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            got = [[float(x) for x in v] for v in encoder(pdf[text].fillna(""))]
            yield pdf.assign(**{vector: got})[out.fieldNames()]

    return items.mapInPandas(run, out).withColumn(vector, vx.unit(F.col(vector)))


def hashed_vectors(items: DataFrame, text: str = "text", vector: str = "vector",
                   size: int = 256) -> DataFrame:
    """M3 without a model: hashed word counts, idf weights, unit length."""
    stages = [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\b\w\w+\b",
                             gaps=False),
              HashingTF(inputCol="_words", outputCol="_hashed", numFeatures=size),
              IDF(inputCol="_hashed", outputCol="_idf"),
              Normalizer(inputCol="_idf", outputCol="_unit", p=2.0)]
    filled = items.fillna("", [text])
    return Pipeline(stages=stages).fit(filled).transform(filled).select(
        *items.columns, vector_to_array("_unit").alias(vector))


# ---- baselines ------------------------------------------------------------------------

def top_template(pairs: DataFrame, reply: str = "brand_reply_text",
                 order: str = "brand_reply_id") -> DataFrame:
    """A5: the first raw reply of the largest template group, as one row."""
    return (pairs.filter(F.col(reply).isNotNull())
            .groupBy(F.sha2(tx.template_key(F.col(reply)), 256).alias("k"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.min(F.struct(F.col(order).alias("first_id"), F.col(reply).alias("reply")))
                 .alias("r"))
            .orderBy(F.desc("n"), "r.first_id").limit(1).select("n", "r.first_id", "r.reply"))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def baseline_runs(items: DataFrame, majority: DataFrame, canned: DataFrame,
                  retrieved: DataFrame) -> DataFrame:
    """The four rule baselines as rows of one run table, without a loop over jobs.

    ``majority`` and ``canned`` are one-row tables; ``retrieved`` is (id, reply,
    top_similarity) from rank 1 of the vector search, and may miss ids.
    """
    label = majority.select("label").scalar()
    answer = canned.select("reply").scalar()

    def row(name: str, reply: Column, escalated: Column, source: str, confidence: Column,
            similarity: Column = _null("double"), reason: Column = _null("string")) -> Column:
        return F.struct(F.lit(name).alias("config"), reply.alias("reply"),
                        escalated.alias("escalated"), reason.alias("escalation_reason"),
                        F.lit(source).alias("escalation_source"),
                        confidence.alias("confidence"), similarity.alias("top_similarity"))

    one = F.lit(1.0)
    # Names of the configs and of the sources of a decision.
    joined = items.join(retrieved, "id", "left").withColumns(
        {"_label": label, "_canned": answer})
    configs = F.array(
        row("trivial_always_auto", _null("string"), F.lit(False), "B0", one),
        row("trivial_always_escalate", _null("string"), F.lit(True), "B0", one,
            reason=F.lit("repeat_contact")),
        row("canned", F.col("_canned"), F.lit(False), "B1", one),
        row("retrieval_verbatim", F.col("reply"), _null("boolean"), "B3", _null("double"),
            F.coalesce("top_similarity", F.lit(0.0))))
    return joined.select("id", F.col("_label").alias("pred"), F.explode(configs).alias("c")).select(
        "id", "pred", "c.*")
