import pytest
from pyspark.sql import functions as F

from replylens.functions import text as tx
from replylens.operators import bm25


def test_terms_are_counted_in_every_row_by_itself(spark):
    """Null and empty texts, and an id that stands twice, are rows of their own."""
    docs = spark.createDataFrame([(1, "refund the refund now"), (1, "refund"), (None, None), (2, "the"), (3, "Cats cat")],
                                 "doc_id long, text string")
    got = [(r["doc_id"], r["length"], sorted((t["term"], t["tf"]) for t in r["terms"])) for r in bm25.counted_terms(docs).collect()]
    want = []
    for r in docs.select("doc_id", tx.tokens(F.col("text")).alias("t")).collect():
        want.append((r["doc_id"], len(r["t"]), sorted((w, r["t"].count(w)) for w in set(r["t"]))))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_own_policy_parts_a_text_once(spark):
    """A test of the found evidence does not part and score the texts a second time."""
    asked = spark.createDataFrame([(1, "refund for cats", "refund cats here\n\nnothing\n\nrefund"), (2, None, "x"), (3, "refund", None)],
                                  "id long, message string, policy string")
    found = bm25.own_policy_evidence(asked).filter(F.size("evidence") > 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2
    rows = {r["id"]: r["evidence"] for r in found.collect()}
    assert list(rows) == [1] and [e["id"] for e in rows[1]] == ["CUSTOM-1", "CUSTOM-3"]
    assert rows[1][0]["score"] > rows[1][1]["score"] > 0 and rows[1][0]["score"] == pytest.approx(round(rows[1][0]["score"], 3))
