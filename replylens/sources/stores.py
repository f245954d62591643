"""Writing: pairs, JSON lines and the vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.operators.retrieval import unit_checked


def write_jsonl(df: DataFrame, path: str) -> None:
    """IO5: one UTF-8 record per line."""
    df.write.json(path)


def export_reviews(reviews: DataFrame, path: str, notice: str) -> None:
    """IO13: reviewed records, each with the notice that applies to them."""
    reviews.withColumn("notice", F.lit(notice)).write.json(path)


def write_pairs(pairs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """IO7: pairs by brand. Every task writes its own rows of each brand; gathering a brand
    first would give one that holds most rows to a single task. Texts of a CSV are quoted,
    so that those of many lines are read back whole."""
    writer = pairs.write.partitionBy("brand")
    if fmt == "csv":
        writer = (writer.option("header", True).option("quoteAll", True).option("escape", '"')
                  .option("ignoreLeadingWhiteSpace", False)
                  .option("ignoreTrailingWhiteSpace", False))
    writer.format(fmt).save(path)


def write_index(index: DataFrame, path: str, vector: str = "vector") -> None:
    """IO8: only unit vectors are stored."""
    unit_checked(index, vector).write.parquet(path)


def read_index(spark: SparkSession, path: str, vector: str = "vector") -> DataFrame:
    """IO8: checked again on load."""
    return unit_checked(spark.read.parquet(path), vector)
