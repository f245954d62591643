"""Reader and writer queries: whole tables through a format and back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from replylens.functions import vectors as vx
from replylens.plans import bindings as b
from replylens.plans.registry import query
from replylens.session import scratch_path
from replylens.sources import readers as rd
from replylens.sources import stores


def _write_csv(df, path):
    (df.write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


@query("IO1_message_csv", f"""
with {b.MESSAGES} select tweet_id, author_id, inbound, created_at::varchar as created_at,
  md5(text) as text_md5, in_response_to_tweet_id from messages""")
def _(spark, sf):
    path = scratch_path(spark, "messages")
    m = b.messages(spark, sf).withColumn("response_tweet_id", F.lit(None).cast("string"))
    _write_csv(m.select(*rd.MESSAGES.fieldNames()), path)
    return rd.read_messages(spark, path).withColumn("text", F.md5("text")).withColumnRenamed(
        "text", "text_md5")


@query("IO2_pairs_csv", f"""
with {b.PAIRS} select brand_reply_id, customer_tweet_id, md5(brand_reply_text) as reply_md5,
  md5(customer_text) as customer_md5, is_substantive from pairs""")
def _(spark, sf):
    path = scratch_path(spark, "pairs")
    _write_csv(b.pairs(spark, sf).select(*rd.PAIRS.fieldNames()), path)
    return rd.read_pairs(spark, path).select(
        "brand_reply_id", "customer_tweet_id", F.md5("brand_reply_text").alias("reply_md5"),
        F.md5("customer_text").alias("customer_md5"), "is_substantive")


@query("IO3_source_guard", "select count(*) as n from documents")
def _(spark, sf):
    path = f"{sf}/documents.parquet"
    rd.require_source(spark, path, min_bytes=1000)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("IO4_jsonl_scan", f"""
with {b.LABEL_ROWS} select id::varchar as id, md5(text) as text_md5, intent, should_escalate,
  escalation_reason, prior_messages, false as corrupt from label_rows
union all select null, null, null, null, null, null, true from documents where doc_id % 100 = 0""")
def _(spark, sf):
    """Every hundredth document also leaves a broken line, which is kept and marked."""
    path = scratch_path(spark, "labels")
    rows = b.label_rows(spark, sf).withColumn("id", F.col("id").cast("string"))
    broken = b.documents(spark, sf).filter("doc_id % 100 = 0").select(F.lit('{"id": ').alias("value"))
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).union(broken).write.text(path)
    return rd.read_jsonl(spark, path, rd.LABELS).select(
        "id", F.md5("text").alias("text_md5"), "intent", "should_escalate", "escalation_reason",
        "prior_messages", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query("IO5_jsonl_sink", "select doc_id, md5(text) as text_md5, lang from documents")
def _(spark, sf):
    path = scratch_path(spark, "jsonl")
    d = b.documents(spark, sf).select("doc_id", "text", "lang")
    stores.write_jsonl(d, path)
    return rd.read_jsonl(spark, path, d.schema).select("doc_id", F.md5("text").alias("text_md5"),
                                                       "lang")


@query("IO7_pairs_by_brand", f"""
with {b.PAIRS} select fmt, brand, brand_reply_id, is_substantive, md5(customer_text) as customer_md5
from pairs, (values ('parquet'), ('csv')) f(fmt)""")
def _(spark, sf):
    pairs = b.pairs(spark, sf).select("brand", "brand_reply_id", "customer_text", "is_substantive")

    def stored(fmt, read):
        path = scratch_path(spark, f"by-brand-{fmt}")
        stores.write_pairs(pairs, path, fmt)
        return read(path).select(F.lit(fmt).alias("fmt"), "brand", "brand_reply_id",
                                 "is_substantive", F.md5("customer_text").alias("customer_md5"))

    # The brand is the name of the folder, so it comes after the columns of the files.
    kinds = T.StructType([*pairs.drop("brand").schema.fields, pairs.schema["brand"]])
    return stored("parquet", spark.read.parquet).unionByName(
        stored("csv", lambda path: rd.read_csv(spark, path, kinds)))


@query("IO8_vector_index", """
select vec_id as id, label::varchar as label, round(list_dot_product(embedding::double[], embedding::double[]), 4) as norm
from embeddings""")
def _(spark, sf):
    path = scratch_path(spark, "index")
    stores.write_index(b.vectors(spark, sf), path)
    return stores.read_index(spark, path).select("id", "label", F.round(
        vx.dot(F.col("vector"), F.col("vector")), 4).alias("norm"))


@query("IO10_labelled_benchmark", "select md5(text) as text_md5, lang as category from documents")
def _(spark, sf):
    path = scratch_path(spark, "benchmark") + ".csv"
    _write_csv(b.documents(spark, sf).select("text", F.col("lang").alias("category")), path)
    return rd.read_benchmark(spark, path).select(F.md5("text").alias("text_md5"), "category")


def _as_array(batches):
    """Lines that make each output file one JSON array, written as the rows stream by."""
    lead = "["
    for pdf in batches:
        for i in range(len(pdf)):
            pdf.at[i, "value"] = lead + pdf.at[i, "value"]
            lead = ","
        yield pdf
    import pandas as pd
    yield pd.DataFrame({"value": ["]" if lead == "," else "[]"]})


@query("IO11_passage_arrays", """
select doc_id::varchar as id, source as title, md5(text) as text_md5 from documents""")
def _(spark, sf):
    path = scratch_path(spark, "passages")
    d = b.documents(spark, sf).select(F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text"))
        .alias("value"))
    d.mapInPandas(_as_array, "value string").write.text(path)
    return rd.read_passages(spark, path).select("id", "title", F.md5("text").alias("text_md5"))


@query("IO12_id_keyed_json", f"""
with {b.RATINGS} select id::varchar as id, grounded, acceptable, null::varchar as note from human
union all select concat(id, 'b'), not grounded, null, 'second' from human""")
def _(spark, sf):
    h = b.human_ratings(spark, sf)
    name = F.col("id").cast("string")
    first = F.struct("grounded", "acceptable", F.lit(None).cast("string").alias("note"))
    second = F.struct((~F.col("grounded")).alias("grounded"),
                      F.lit(None).cast("boolean").alias("acceptable"), F.lit("second").alias("note"))
    packed = h.select(F.to_json(F.create_map(name, first, F.concat(name, F.lit("b")), second))
                      .alias("value"))
    return rd.rows_of_map(packed, "value", rd.VERDICT).select("id", "grounded", "acceptable", "note")


@query("IO13_review_export", """
select doc_id as id, md5(text) as reply_md5, 'Edits are not sent' as notice from documents""")
def _(spark, sf):
    path = scratch_path(spark, "reviews")
    reviews = b.documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("reply"))
    stores.export_reviews(reviews, path, "Edits are not sent")
    stored = T.StructType([*reviews.schema.fields, T.StructField("notice", T.StringType())])
    return spark.read.schema(stored).json(path).select("id", F.md5("reply").alias("reply_md5"), "notice")
