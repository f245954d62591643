import json
import os

import pytest
from pyspark.sql import functions as F

from replylens.operators import joins as jn
from replylens.sources import readers as rd
from replylens.sources import results, stores


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,'
                    'in_response_to_tweet_id\n'
                    '1,Shop,False,x,"He said ""hi""\nand left, é",,2\n2,u,True,x,hello,1,\n',
                    encoding="utf-8")
    rows = rd.read_messages(spark, str(path)).orderBy("tweet_id").collect()
    assert rows[0]["text"] == 'He said "hi"\nand left, é'
    assert (rows[0]["inbound"], rows[0]["in_response_to_tweet_id"]) == (False, "2")
    assert (rows[1]["inbound"], rows[1]["in_response_to_tweet_id"]) == (True, None)


def test_source_guard(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        rd.require_source(spark, str(tmp_path / "none.csv"))
    small = tmp_path / "small.csv"
    small.write_text("a\n")
    with pytest.raises(ValueError, match="preview"):
        rd.require_source(spark, str(small))
    assert rd.require_source(spark, str(small), min_bytes=1) == 2


def test_jsonl(spark, tmp_path):
    assert rd.read_jsonl(spark, str(tmp_path / "none"), rd.WEAK_LABELS).count() == 0
    path = tmp_path / "w.jsonl"
    path.write_text('{"id": "1", "text": "é", "weak_intent": "other", "weak_confidence": 0.5}\n\n'
                    '{"id": "2", "weak_intent": null, "error": "limit"}\nnot json\n', encoding="utf-8")
    rows = rd.read_jsonl(spark, str(path), rd.WEAK_LABELS).collect()
    assert len(rows) == 3 and sum(r["_corrupt_record"] is not None for r in rows) == 1
    stores.write_jsonl(spark.createDataFrame([("é",)], "t string"), str(tmp_path / "o"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o").glob("part*"))
    assert text.strip() == '{"t":"é"}'


def test_result_store_keeps_the_newest_good_attempt(spark, tmp_path):
    path = str(tmp_path / "r")
    schema = "config string, id string, pred string, error string"
    results.append_results(spark.createDataFrame([("c", "1", "a", None), ("c", "2", None, "limit"),
                                                 ("d", "1", "z", None)], schema), path, 1)
    results.append_results(spark.createDataFrame([("c", "1", None, "limit"), ("c", "2", "b", None)],
                                                schema), path, 2)
    got = {(r["config"], r["id"]): r["pred"] for r in results.read_results(spark, path).collect()}
    assert got == {("c", "1"): "a", ("c", "2"): "b", ("d", "1"): "z"}
    items = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    done = spark.read.parquet(path).filter("config = 'c' and run_ts = 1")
    assert sorted(r["id"] for r in jn.work_remaining(items, done).collect()) == ["2", "3"]
    state = jn.progress(items, done).first()
    assert (state["wanted"], state["done"], state["errored"]) == (3, 1, 1)


def test_id_map_and_passages(spark, tmp_path):
    ratings = {"7": {"grounded": True, "acceptable": False, "note": "n"}, "8": {"grounded": False}}
    (tmp_path / "h.json").write_text(json.dumps(ratings, indent=2))
    got = {r["id"]: r for r in rd.read_id_map(spark, str(tmp_path / "h.json")).collect()}
    assert got["7"]["grounded"] and got["7"]["note"] == "n" and got["8"]["acceptable"] is None
    (tmp_path / "k.json").write_text(json.dumps([{"id": "K1", "title": "t", "text": "x"},
                                                 {"id": "K2", "title": "u", "text": "y"}]))
    rows = rd.read_passages(spark, str(tmp_path / "k.json")).orderBy("ord").collect()
    assert [r["id"] for r in rows] == ["K1", "K2"]


def test_pairs_by_brand_use_many_files(spark, tmp_path):
    df = spark.range(1000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("brand"),
                                  F.col("id").cast("string").alias("brand_reply_id"))
    stores.write_pairs(df.repartition(4), str(tmp_path / "p"))
    assert len([f for f in os.listdir(tmp_path / "p" / "brand=a") if f.endswith("parquet")]) == 4
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1000


def test_csv_pairs_keep_texts_of_many_lines(spark, tmp_path):
    from replylens.sources import readers as rd
    rows = [("1", 'two\nlines, "quoted"', "a"), ("2", "  spaced ", "b"), ("3", "back\\slash\n\n", "a")]
    df = spark.createDataFrame(rows, "brand_reply_id string, customer_text string, brand string")
    stores.write_pairs(df, str(tmp_path / "c"), "csv")
    assert sorted(tuple(r) for r in rd.read_csv(spark, str(tmp_path / "c"), df.schema).collect()) == rows


def test_human_ratings_of_the_case_library(spark):
    cases = spark.createDataFrame(
        [(1, "Refund me", "how_to", "how_to", True, False, True, False),
         (2, "other", "a", None, False, True, None, True),
         (3, "é x", "a", "b", False, False, True, True)],
        "id long, text string, gold string, pred string, should_escalate boolean, "
        "escalated boolean, judge_acceptable boolean, human_acceptable boolean")

    def ids(needle="", mode="all"):
        return sorted(r["id"] for r in jn.search_cases(cases, needle, mode).collect())

    assert ids() == [1, 2, 3] and ids("REFUND") == [1] and ids("É") == [3]
    assert ids(mode="missed") == [1] and ids(mode="escalated") == [2]
    assert ids(mode="wrong") == [2, 3] and ids(mode="disagreement") == [1]
