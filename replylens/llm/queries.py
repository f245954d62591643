"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.llm import (decontam, itq, langid, lattice, licenses, linedup, packing, quality, resample, simhash,
                           tokencount, warc, whitening)
from replylens.llm.common import table


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file, the same on every node."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf, "documents")).drop("spans")


def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = linedup.dedup_lines(table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", "n_removed",
                        F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op4_lattice_score(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.score_texts(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_warc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


def op6_embedding_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return itq.link_vectors(table(spark, sf, "embeddings"))


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "documents"))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_simhash_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.group_documents(table(spark, sf, "documents"))


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op11_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge_texts(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "posterior", "votes")


def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_line_dedup, op4_lattice_score,
                            op5_warc_round_trip, op6_embedding_neardup, op7_language_id,
                            op8_decontamination, op9_simhash_neardup, op10_token_counts,
                            op11_quality_rules, op12_embedding_whitening, op13_importance_resampling)}

SQL: dict[str, str] = {"op1_license_scan": licenses.sql(), "op3_line_dedup": linedup.sql(),
                       "op5_warc_round_trip": warc.SQL, "op13_importance_resampling": resample.sql()}
