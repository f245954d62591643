import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replylens.functions import policy as po
from replylens.operators import live, reconcile


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, prior, reason, rule", [
    ("Somebody HACKED into it", 0, "security_risk", "E1"),
    ("give me a refund today", 0, "money_movement", "E2"),
    ("you charged me 3 times", 0, "money_movement", "E2"),
    ("my solicitor will write to you", 0, "legal_or_reputational", "E3"),
    ("I want to die", 0, "safety", "E4"),
    ("stolen card, I need a refund and a lawyer", 0, "security_risk", "E1"),
    ("a refund or my lawyer calls", 5, "money_movement", "E2"),
    ("still the same problem", 2, "repeat_contact", "E5"),
    ("still the same problem", 1, None, None),
    ("how can I change the colour", 0, None, None),
    ("we met at the courtyard", 0, None, None),
    ("the hackathon was fun", 0, None, None),
    ("pursue another plan", 0, None, None),
    (None, 0, None, None),
])
def test_policy(spark, text, prior, reason, rule):
    got = one(spark, "t string, p int", (text, prior), po.apply_policy(F.col("t"), F.col("p")))
    assert (got["should_escalate"], got["reason"], got["rule"]) == (rule is not None, reason, rule)


def test_explain_lists_every_rule(spark):
    got = one(spark, "t string, p int", ("Refund me or see you in court", 3),
              po.explain_policy(F.col("t"), F.col("p")))
    assert [(h["rule"], h["matched"]) for h in got] == [
        ("E2", "Refund"), ("E3", "court"), ("E5", "3 prior messages")]


@pytest.mark.parametrize("text, conf, sim, reason, source", [
    ("my account was hacked", 0.1, 0.1, "security_risk", "E1"),
    ("what is this", 0.3, 0.9, "low_confidence", "R1"),
    ("what is this", 0.3, 0.1, "low_confidence", "R1"),
    ("what is this", 0.9, 0.1, "no_precedent", "R2"),
    ("what is this", 0.9, 0.9, None, None),
    ("what is this", None, None, None, None),
    ("what is this", 0.55, 0.45, None, None),
    ("what is this", None, 0.2, "no_precedent", "R2"),
])
def test_decision(spark, text, conf, sim, reason, source):
    got = one(spark, "t string, c double, s double", (text, conf, sim),
              po.decide(F.col("t"), F.col("c"), F.col("s")))
    assert (got["reason"], got["rule"]) == (reason, source)
    assert got["should_escalate"] == (source is not None)


@pytest.mark.parametrize("text, n", [
    ("I was charged twice", 1), ("not hacked, only a question", 0), ("I'm not hacked", 0),
    ("I was hacked", 1), ("someone changed the email of my account", 1),
    ("my card was stolen, I will go to court", 3), ("how do I sort a list", 0), (None, 0)])
def test_risk_signals(spark, text, n):
    got = one(spark, "t string", (text,), po.risk_signals(F.col("t")))
    assert len(got) == n == len(set(got))


REQUEST = T.StructType([
    T.StructField("message", T.StringType()), T.StructField("policy", T.StringType()),
    T.StructField("history", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))])


@pytest.mark.parametrize("row, codes", [
    (("hello there", None, None), []),
    (("  hi  ", None, []), ["invalid_message"]),
    (("x" * 2001, None, None), ["invalid_message"]),
    ((None, "p" * 8001, None), ["invalid_message", "invalid_policy"]),
    (("hello", "p" * 8000, [("user", "a")] * 4), []),
    (("hello", None, [("user", "a")] * 5), ["invalid_history"]),
    (("hello", None, [("system", "a")]), ["invalid_history"]),
    (("hello", None, [("user", None)]), ["invalid_history"]),
    (("hello", None, [("assistant", "y" * 2001)]), ["invalid_history"]),
])
def test_request_limits(spark, row, codes):
    got = one(spark, REQUEST, row, po.request_violations(
        F.col("message"), F.col("history"), F.col("policy")))
    assert got == codes


GOOD = {"intent": "how_to", "confidence": 0.9, "summary": "s", "answer": "a",
        "cited_doc_ids": ["K1"], "needs_human": False, "handoff_reason": "",
        "clarification_question": ""}


@pytest.mark.parametrize("change, codes", [
    ({}, []), ({"confidence": 1.2}, ["confidence"]), ({"confidence": None}, ["confidence"]),
    ({"intent": "weather"}, ["intent"]), ({"cited_doc_ids": ["K1", "zz"]}, ["unknown_citation"]),
    ({"cited_doc_ids": ["K1"] * 5}, ["cited_doc_ids"]), ({"cited_doc_ids": []}, []),
    ({"answer": "a" * 1601}, ["answer"]), ({"needs_human": None}, ["needs_human"]),
    ({"cited_doc_ids": [None]}, ["unknown_citation"])])
def test_output_checks(spark, change, codes):
    raw = json.dumps({**GOOD, **change})
    df = spark.createDataFrame([(raw, ["K1", "K2"])], "raw string, ids array<string>")
    got = df.select(po.parse_output(F.col("raw")).alias("o"), "ids").select(
        po.output_violations(F.col("o"), F.col("ids")).alias("v")).first()["v"]
    assert got == codes


def test_malformed_output_breaks_everything(spark):
    df = spark.createDataFrame([("{not json", ["K1"])], "raw string, ids array<string>")
    got = df.select(po.output_violations(po.parse_output(F.col("raw")), F.col("ids"))).first()[0]
    assert "intent" in got and "answer" in got


def route(spark, **over):
    base = dict(message="a plain question", intent="how_to", needs=False, handoff="", conf=0.9,
                n=1, cited=["K1"], answer="Try again.", clar="")
    base.update(over)
    df = spark.createDataFrame(
        [(base["message"], base["intent"], base["needs"], base["handoff"], base["conf"], base["n"],
          base["cited"], base["answer"], base["clar"], over.get("history"))],
        "message string, intent string, needs boolean, handoff string, conf double, n int, "
        "cited array<string>, answer string, clar string, "
        "history array<struct<role:string,text:string>>")
    c = F.col
    return df.select(po.route(c("message"), c("history"), c("intent"), c("needs"), c("handoff"),
                              c("conf"), c("n"), c("cited"), c("answer"), c("clar"))
                     .alias("r")).first()["r"]


def test_routing(spark):
    ok = route(spark)
    assert (ok["routing"], ok["routing_reasons"], ok["needs_human"]) == ("draft_ready", [], False)
    assert route(spark, intent="account_security")["routing_reasons"] == [po.R_SPECIALIST]
    assert route(spark, needs=True)["routing_reasons"] == [po.R_MODEL]
    assert route(spark, needs=True, handoff="Ask Kim")["routing_reasons"] == ["Ask Kim"]
    assert route(spark, conf=0.69)["routing_reasons"] == [po.R_CONFIDENCE]
    uncited = route(spark, cited=[])
    assert (uncited["answer"], uncited["routing_reasons"]) == (po.NO_SUPPORT_ANSWER, [po.R_UNCITED])
    assert route(spark, cited=[], clar="Which phone?")["answer"] == "Which phone?"
    unsafe = route(spark, answer="I have refunded you")
    assert (unsafe["answer"], unsafe["routing_reasons"]) == (po.WITHHELD_ANSWER, [po.R_UNSAFE])
    past = route(spark, history=[("user", "I was hacked"), ("assistant", "my lawyer")])
    assert past["routing_reasons"] == ["Suspected account security issue"]


def test_label_reconciliation(spark):
    rows = [
        ("a", "want a refund", True, None, "", False), ("b", "hello", False, "safety", "", False),
        ("c", "want a refund", True, "low_confidence", "", False),
        ("d", "want a refund", False, None, "read it, fine", False),
        ("e", "want a refund", False, None, "", False),
        ("f", "want a refund", False, None, "later", True),
        ("g", "want a refund", True, "money_movement", "", False),
        ("h", "want a refund", True, "safety", "", False)]
    df = spark.createDataFrame(rows, "id string, text string, should_escalate boolean, "
                               "escalation_reason string, notes string, needs_review boolean")
    got = reconcile.reconcile_labels(df.withColumn("prior_messages", F.lit(None).cast("int")))
    by_id = {r["id"]: r for r in got.collect()}
    assert by_id["a"]["errors"] == ["escalate_without_reason"]
    assert by_id["b"]["errors"] == ["reason_without_escalate"]
    assert by_id["c"]["errors"] == ["reason_not_allowed"]
    assert {k: by_id[k]["status"] for k in "adefgh"} == {
        "a": "agrees", "d": "deliberate", "e": "unexplained", "f": "unexplained", "g": "agrees",
        "h": "unexplained"}
    total = reconcile.reconciliation_counts(got).first()
    assert (total["schema_errors"], total["deliberate"], total["unexplained"], total["pending"],
            total["problems"]) == (3, 1, 4, 1, 8)


def test_acceptable_ignores_tone(spark):
    df = spark.createDataFrame([(True, True, True), (False, True, True), (None, True, True)],
                               "g boolean, a boolean, n boolean")
    assert [r[0] for r in df.select(po.acceptable(F.col("g"), F.col("a"), F.col("n"))).collect()] \
        == [True, False, False]


def test_live_decision(spark):
    good = {"intent": po.INTENTS[0], "confidence": 0.9, "answer": "Restart it.", "summary": "s",
            "needs_human": False, "cited_doc_ids": ["A"], "handoff_reason": "",
            "clarification_question": ""}
    cases = [("the speaker is silent", good), ("the speaker is silent", {**good, "cited_doc_ids": ["Z"]}),
             ("the speaker is silent", None), ("hi", good), ("zzz yyy", {**good, "cited_doc_ids": []}),
             ("the speaker is silent", {**good, "confidence": 0.5})]
    asked = spark.createDataFrame(
        [(i, m, [], None, json.dumps(r) if r else "{oops") for i, (m, r) in enumerate(cases)],
        "request_id long, message string, history array<struct<role:string,text:string>>, "
        "policy string, raw string")
    known = spark.createDataFrame([(0, "A", "Speaker", "a silent speaker needs a restart")],
                                  "ord long, id string, title string, text string")
    got = {r["request_id"]: r["decision"] for r in live.live_decisions(asked, known).collect()}
    assert [got[i]["routing"] for i in range(6)] == [
        "draft_ready", "human_review", "human_review", "rejected", "human_review", "human_review"]
    assert got[0]["answer"] == "Restart it." and got[1]["answer"] is got[2]["answer"] is None
    assert got[1]["routing_reasons"] == got[2]["routing_reasons"] == [live.HELD]
    assert got[3]["routing_reasons"] == ["invalid_message"]
    assert got[4]["answer"] == po.NO_SUPPORT_ANSWER and got[4]["routing_reasons"] == [po.R_UNCITED]
    assert got[5]["routing_reasons"] == [po.R_CONFIDENCE] and got[5]["answer"] == "Restart it."
