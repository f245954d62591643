"""Reading the source tables: explicit schemas, no inference, checks before work starts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replylens.sources.arrays import read_json_array
from replylens.sources.quoted import read_quoted_csv


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


MESSAGES = T.StructType([
    T.StructField("tweet_id", T.StringType()), T.StructField("author_id", T.StringType()),
    T.StructField("inbound", T.BooleanType()), T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("response_tweet_id", T.StringType()),
    T.StructField("in_response_to_tweet_id", T.StringType())])
MESSAGE_COLUMNS = ["tweet_id", "author_id", "inbound", "created_at", "text",
                   "in_response_to_tweet_id"]
PAIRS = _strings("brand_reply_id", "brand_reply_text", "customer_tweet_id",
                 "customer_author_id", "customer_text", "created_at").add(
    "is_substantive", T.BooleanType())
POOL = _strings("id").add("seq", T.LongType()).add("text", "string").add(
    "brand_reply", "string").add("split", "string").add("stratum", "string").add(
    "is_hard", T.BooleanType()).add("hard_reason", "string").add("weak_intent", "string")
LABELS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("intent", T.StringType()), T.StructField("should_escalate", T.BooleanType()),
    T.StructField("escalation_reason", T.StringType()),
    T.StructField("is_hard", T.BooleanType()), T.StructField("notes", T.StringType()),
    T.StructField("needs_review", T.BooleanType()),
    T.StructField("escalation_hand_confirmed", T.BooleanType()),
    T.StructField("split", T.StringType()), T.StructField("stratum", T.StringType()),
    T.StructField("prior_messages", T.LongType()), T.StructField("labelled_at", T.StringType())])
WEAK_LABELS = _strings("id", "text", "weak_intent").add(
    "weak_confidence", T.DoubleType()).add("error", "string")
VERDICT = T.StructType([
    *[T.StructField(d, T.BooleanType()) for d in
      ("grounded", "addresses_ask", "no_overpromise", "tone_ok", "acceptable")],
    T.StructField("note", T.StringType()), T.StructField("error", T.StringType())])
PASSAGES = _strings("id", "title", "text")
BENCHMARK = _strings("text", "category")

# A file below this size is taken for a preview of the real table.
MIN_BYTES = 50_000_000


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header and quoted, possibly multi-line text; one task reads a file."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """IO1: the raw message table, only the columns pairing needs, read in byte ranges."""
    return read_quoted_csv(spark, path, MESSAGES).select(*MESSAGE_COLUMNS)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """IO2: the stored pairs, read in byte ranges."""
    return read_quoted_csv(spark, path, PAIRS)


def source_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(path)
    return int(fs.getContentSummary(where).getLength())


def require_source(spark: SparkSession, path: str, min_bytes: int = MIN_BYTES) -> int:
    """IO3: stop before the first job if the source is missing or too small to be it."""
    size = source_bytes(spark, path)
    if size < min_bytes:
        raise ValueError(f"{path} holds {size} bytes, expected at least {min_bytes}; "
                         "this looks like a preview of the table")
    return size


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """IO4: one record per line; a line that does not parse is kept in ``_corrupt_record``.

    A missing path is an empty table, which is what a first run sees.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    try:
        return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """IO11: a JSON array of passages, with their order in the file, read in byte ranges."""
    return read_json_array(spark, path, PASSAGES)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """IO10: a local (text, category) table, CSV or Parquet."""
    if path.rstrip("/").endswith(".csv"):
        return read_quoted_csv(spark, path, BENCHMARK)
    return spark.read.schema(BENCHMARK).parquet(path)


def rows_of_map(df: DataFrame, column: str, record: T.StructType) -> DataFrame:
    """IO12: a JSON object keyed by id, in a text column, as one row per id."""
    parsed = F.from_json(F.col(column), T.MapType(T.StringType(), record))
    return df.select(F.explode(parsed).alias("id", "r")).select("id", "r.*")


def read_id_map(spark: SparkSession, path: str, record: T.StructType = VERDICT) -> DataFrame:
    """IO12: whole files that each hold one JSON object keyed by id."""
    return rows_of_map(spark.read.text(path, wholetext=True), "value", record)
