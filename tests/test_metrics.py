import math
import random

import pytest
from pyspark.sql import functions as F

from replylens.functions import stats as st
from replylens.operators import metrics as me


def pairs(spark, rows):
    return spark.createDataFrame(rows, "gold string, pred string")


def summary(spark, rows, labels):
    counts = me.confusion_counts(pairs(spark, rows))
    return me.accuracy(counts).first(), me.averaged_f1(me.per_class(counts, labels)).first()


def test_rare_class_hides_in_accuracy(spark):
    acc, f = summary(spark, [("common", "common")] * 95 + [("rare", "common")] * 5,
                     ["common", "rare"])
    assert acc["acc"] == 0.95
    assert f["macro_f1"] < 0.5 < f["weighted_f1"]


def test_off_taxonomy_is_wrong_and_null_is_not_graded(spark):
    acc, _ = summary(spark, [("a", "a"), ("b", "zzz"), ("b", None)], ["a", "b"])
    assert (acc["acc_correct"], acc["acc_n"], acc["acc"]) == (1, 2, 0.5)


def test_empty_input(spark):
    acc, f = summary(spark, [("a", None)], ["a"])
    assert (acc["acc_n"], acc["acc"]) == (0, 0.0)
    assert f["macro_f1"] == 0.0


def test_scores_equal_a_direct_count(spark):
    rng = random.Random(5)
    labels = list("abcde")
    rows = [(rng.choice("abcd"), rng.choice("abcx")) for _ in range(600)]
    _, f = summary(spark, rows, labels)
    f1s, supports = [], []
    for c in labels:
        tp = sum(g == p == c for g, p in rows)
        fp = sum(p == c != g for g, p in rows)
        fn = sum(g == c != p for g, p in rows)
        f1s.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
        supports.append(tp + fn)
    assert f["macro_f1"] == pytest.approx(sum(f1s) / len(labels), abs=1e-9)
    assert f["weighted_f1"] == pytest.approx(
        sum(a * b for a, b in zip(f1s, supports)) / sum(supports), abs=1e-9)
    grid = me.confusion_grid(me.confusion_counts(pairs(spark, rows)), labels).collect()
    assert len(grid) == len(labels) * (len(labels) + 1)
    assert sum(r["n"] for r in grid) == len(rows)
    assert {r["gold"]: r["n"] for r in grid if r["pred"] == me.OTHER}["a"] == \
        sum(g == "a" and p == "x" for g, p in rows)


def kappa(spark, rows):
    return me.agreement(me.confusion_counts(pairs(spark, rows))).first()


def test_kappa(spark):
    k = kappa(spark, [("y", "y")] * 39 + [("y", "n")] + [("n", "y")] * 5 + [("n", "n")] * 6)
    p_o, p_e = 45 / 51, (40 * 44 + 11 * 7) / 51 ** 2
    assert k["kappa"] == pytest.approx((p_o - p_e) / (1 - p_e), abs=1e-12)
    assert (k["band"], k["verdict"]) == ("moderate", "moderate")


def test_kappa_undefined(spark):
    one_class = kappa(spark, [("y", "y")] * 7)
    assert (one_class["raw"], one_class["kappa"], one_class["band"]) == (1.0, None, "undefined")
    empty = kappa(spark, [("y", None)])
    assert empty is None or (empty["n"], empty["raw"], empty["kappa"]) == (0, None, None)


def test_independent_biased_raters_agree_by_luck_only(spark):
    rng = random.Random(11)
    rows = [tuple("y" if rng.random() < 0.8 else "n" for _ in range(2)) for _ in range(4000)]
    k = kappa(spark, rows)
    assert k["raw"] > 0.6 and abs(k["kappa"]) < 0.08


@pytest.mark.parametrize("s, n", [(119, 140), (140, 140), (0, 140), (7, 60), (0, 0)])
def test_wilson(spark, s, n):
    df = spark.createDataFrame([(s, n)], "s long, n long")
    w = df.select(st.wilson(F.col("s"), F.col("n")).alias("w"),
                  st.interval_text(F.col("s"), F.col("n")).alias("t")).first()
    if n == 0:
        assert (w["w"]["point"], w["w"]["low"], w["w"]["high"], w["t"]) == (None, None, None, "n/a")
        return
    z, p = st.Z95, s / n
    # The bounds are the roots of (p - x)^2 = z^2 x (1 - x) / n.
    a, b, c = 1 + z * z / n, -(2 * p + z * z / n), p * p
    root = math.sqrt(max(b * b - 4 * a * c, 0))
    assert w["w"]["low"] == pytest.approx(max(0, (-b - root) / (2 * a)), abs=1e-12)
    assert w["w"]["high"] == pytest.approx(min(1, (-b + root) / (2 * a)), abs=1e-12)


def test_threshold_grid_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 0.0, 0.3, 0.5, 0.50001, 1.0]), rng.choice([None, 0.2, 0.45, 0.9]),
             rng.random() < 0.2, rng.random() < 0.3) for _ in range(300)]
    df = spark.createDataFrame(
        rows, "confidence double, top_similarity double, escalated boolean, should_escalate boolean")
    taus, sigmas = [i / 10 for i in range(11)], [0.0, 0.45, 0.9]
    got = {(r["tau"], r["sigma"]): r for r in me.threshold_what_if(df, taus, sigmas).collect()}
    assert len(got) == len(taus) * len(sigmas)
    for t in taus:
        for s in sigmas:
            tp = fp = fn = 0
            for c, m, e, x in rows:
                review = e or (c is not None and c < t) or (m is not None and m < s)
                tp, fp, fn = tp + (review and x), fp + (review and not x), fn + (not review and x)
            r = got[(t, s)]
            assert (r["tp"], r["fp"], r["fn"], r["review"]) == (tp, fp, fn, tp + fp)
            assert r["precision"] == (pytest.approx(tp / (tp + fp)) if tp + fp else None)


def test_config_without_a_decision_has_no_score(spark):
    df = spark.createDataFrame(
        [("c", 1, "a", "a", True, None, False, False, 1, 1, 0.5, None),
         ("c", 2, "a", None, False, None, True, True, 1, 1, 0.5, "boom"),
         ("d", 1, "a", None, True, False, False, False, 0, 0, 0.0, None)],
        "config string, id int, gold string, pred string, should_escalate boolean, "
        "escalated boolean, is_hard boolean, replied boolean, input_tokens int, output_tokens int, "
        "latency_s double, error string")
    got = {r["config"]: r for r in me.config_summary(df, ["a", "b"]).collect()}
    assert (got["c"]["n"], got["c"]["errors"], got["c"]["acc_n"], got["c"]["acc"]) == (2, 1, 1, 1.0)
    assert got["c"]["esc_recall"] is None and got["c"]["auto_rate"] is None
    assert (got["d"]["acc"], got["d"]["macro_f1"], got["d"]["esc_recall"], got["d"]["esc_missed"],
            got["d"]["auto_rate"]) == (None, None, 0.0, 1, 1.0)
    assert got["c"]["reply_rate"] == 0.5 and got["c"]["tokens"] == 2.0


def test_duplicates_and_majority(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "t string")
    r = me.duplicate_rate(df, "t").first()
    assert (r["rows"], r["duplicates"]) == (3, 2)
    assert me.majority_label(df, "t").first()["label"] == "x"
    assert me.majority_label(df.filter("t = 'q'"), "t", "none").first()["label"] == "none"


def test_bias_direction(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, True), (True, False)],
                               "human boolean, judge boolean")
    r = me.bias_direction(df, "human", "judge").first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"], r["leans"]) == (1, 1, 2, 0, "generous")
