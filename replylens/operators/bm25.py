"""BM25 over passages: corpus counts, term weights, a request's own policy. Searches use ``textindex``."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from replylens.functions import text as tx

# Ranking constants and the number of passages kept.
K1, B, TOP = 1.2, 0.75, 4


def idf(n_docs: Column, df: Column) -> Column:
    """T8."""
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, length: Column, average: Column) -> Column:
    """The part of the score that depends on one passage and one term."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def corpus_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """Number of passages and mean token count, as one row."""
    return docs.select(F.size(tx.tokens(F.col(text))).alias("n")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_len"))


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """Passages containing each term; each passage counts a term once."""
    return (docs.select(F.explode(F.array_distinct(tx.tokens(F.col(text)))).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    return queries.select(query_id, F.explode(
        F.array_distinct(tx.tokens(F.col(text)))).alias("term"))


def matched_terms(queries: DataFrame, docs: DataFrame, query_id: str,
                  text: str = "text") -> DataFrame:
    """Queries, passages and occurrences that meet on each query term.

    Both sides are counted per term first, so the join sees one row per term.
    """
    q = query_terms(queries, query_id, text).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_queries"))
    d = docs.select(F.explode(tx.tokens(F.col(text))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("occurrences"))
    return q.join(d, "term").join(document_frequency(docs, text), "term")


def own_policy_evidence(requests: DataFrame, message: str = "message", policy: str = "policy",
                        k: int = TOP, limit: int | None = None) -> DataFrame:
    """T9 with T8: each request searched against the passages of its own policy text.

    Everything happens inside the row, and texts are parted once; a live request passes ``text.LIVE_SECTIONS`` as the
    limit. Adds
    ``evidence``, array<struct<id, score>>.
    """
    cut = F.transform(tx.passages(F.col(policy), limit=limit), lambda p: F.struct(
        p["id"].alias("id"), tx.tokens(F.concat_ws(" ", p["title"], p["text"])).alias("t")))
    out = T.StructType([*requests.schema.fields, T.StructField("_scores", T.ArrayType(T.StructType([
        T.StructField("ord", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())])))])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            found = [_passage_scores(p or [], w or []) for p, w in zip(
                batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(found, arrow.field("_scores").type)], schema=arrow)

    ranked = F.array_sort(F.filter(F.transform("_scores", lambda p: F.struct(
        (-F.round(p["score"], 3)).alias("neg"), p["ord"].alias("ord"), p["id"].alias("id"))),
        lambda x: x["neg"] < 0))
    return (requests.withColumns({"_passages": cut, "_terms": F.array_distinct(tx.tokens(F.col(message)))})
            .mapInArrow(run, out)
            .withColumn("evidence", F.transform(F.slice(ranked, 1, k), lambda x: F.struct(
                x["id"].alias("id"), (-x["neg"]).alias("score"))))
            .drop("_scores"))


def _passage_scores(passages: list[dict], terms: list[str]) -> list[dict]:
    """The passages of one policy that hold a term: their places, ids and scores, terms added in order."""
    counts = [Counter(p["t"]) for p in passages]
    n, average = len(passages), sum(len(p["t"]) for p in passages) / max(1, len(passages))
    weights = [(w, math.log(1 + (n - df + 0.5) / (df + 0.5)))
               for w in terms if (df := sum(w in c for c in counts))]
    found = []
    for i, (p, c) in enumerate(zip(passages, counts)):
        shape = K1 * (1 - B + B * len(p["t"]) / average) if average else 0.0
        score = sum((weight * (c[w] * (K1 + 1) / (c[w] + shape)) for w, weight in weights if w in c), 0.0)
        if score:
            found.append({"ord": i, "id": p["id"], "score": score})
    return found


def counted_terms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, length, terms): every passage's number of tokens and its distinct ones as (term, tf)."""
    out = T.StructType([docs.schema[doc_id], T.StructField("length", T.IntegerType()), T.StructField(
        "terms", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = pc.dictionary_encode(lists.flatten())
            size = max(1, len(words.dictionary))
            pair, tf = np.unique(np.repeat(np.arange(len(lens)), lens) * size
                                 + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, code = np.divmod(pair, size)
            items = pa.StructArray.from_arrays([words.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(tf)], ["term", "tf"])
            ends = np.searchsorted(row, np.arange(len(lens) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lens.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends), items).cast(arrow.field("terms").type)], schema=arrow)

    return docs.select(doc_id, tx.tokens(F.col(text)).alias("t")).mapInArrow(run, out)
