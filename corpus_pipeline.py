"""A corpus pipeline: every stage takes documents and returns those it keeps.

Stages run in order; each result is written as Parquet and read again as the documents of
the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.llm import decontam, langid, linedup, packing, simhash
from replylens.llm.common import stored, table
from replylens.llm.queries import vocabulary


def _beside(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``found`` with its columns renamed, so that joining it to ``docs`` is unambiguous."""
    return docs, found.select(*[F.col(c).alias(f"__{c}") for c in found.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Those without a letter are rejected.

    The model is fitted on labelled documents of this input; without any, the letter alone decides.
    """
    model = langid.fit_languages(docs)
    if model.families is None:
        model = langid.letters_only()
    docs, found = _beside(docs, langid.predict_languages(docs, model).filter(f"lang_pred = '{langid.UNKNOWN}'")
                          .select("doc_id").distinct())
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__doc_id"]), "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; emptied ones go.

    ``n_chars`` follows the text.
    """
    return linedup.remove_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    groups = simhash.group_documents(docs)
    docs, gone = _beside(docs, groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
                         .select("doc_id").distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__doc_id"]), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    docs, gone = _beside(docs, leaks.select("doc_id").distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__doc_id"]), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their places in sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

# Language models, fingerprints and token ids are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
