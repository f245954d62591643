"""The check against others' labels, held against plain loops."""

from collections import Counter

import pytest

from replylens.operators import benchmark as bench

WORDS = {"card": "my card has not come", "top_up": "the top up was turned back", "limit": "what is my limit today"}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(f"{text} {'please' * (i % 3)} {i % 5}", c) for c, text in WORDS.items() for i in range(12)]
    train = spark.createDataFrame([*rows, (None, "card"), ("no label", None)], "text string, category string")
    test = spark.createDataFrame([*[(t + " now", c) for t, c in rows], ("card limit", "rare"), (None, "card"), ("x", None)],
                                 "text string, category string")
    return train, test


def marks():
    """A scorer that raises where a text is null; made here, so that it travels by value."""
    def scorer(pdf):
        if pdf["text"].isna().any():
            raise ValueError("no text")
        return pdf[["text"]].assign(pred=["card" if "card" in t else "elsewhere" for t in pdf["text"]], error=None)[["pred", "error"]]
    return scorer


def by_loops(rows):
    """Summary of one approach's (gold, pred) rows."""
    graded = [(g, p) for g, p in rows if p is not None]
    labels, known = {x for r in graded for x in r}, {g for g, _ in rows}
    tp, said, true = (Counter(x) for x in ([g for g, p in graded if g == p], [p for _, p in graded], [g for g, _ in graded]))
    f1 = [2 * tp[x] / (said[x] + true[x]) for x in labels]
    return {"n": len(graded), "errors": len(rows) - len(graded), "off_taxonomy": sum(p not in known for _, p in graded),
            "classes": len(true), "correct": sum(tp.values()), "macro_f1": pytest.approx(sum(f1) / len(f1) if f1 else None)}


def test_summary_and_confusions(spark, tables):
    scored = bench.external_check(*tables, {"marks": marks()}, per_category=3)
    rows = {}
    for r in scored.collect():
        rows.setdefault(r["approach"], []).append((r["gold"], r["pred"]))
    assert len(rows["classifier"]) == 38 and len(rows["marks"]) == 10      # three of three categories, one rare text
    found = {r["approach"]: r for r in bench.check_summary(scored).collect()}
    assert found.keys() == rows.keys()
    for name, own in rows.items():
        want = by_loops(own)
        assert {k: found[name][k] for k in want} == want
        assert found[name]["low"] <= found[name]["acc"] <= found[name]["high"] and found[name]["interval"]
    assert found["classifier"]["acc"] > 0.9
    assert found["marks"]["off_taxonomy"] > 0
    wrong = Counter(r for r in rows["marks"] if r[1] is not None and r[0] != r[1])
    got = {(r["gold"], r["pred"]): r["n"] for r in bench.check_confusions(scored).filter("approach = 'marks'").collect()}
    assert got == wrong


def test_an_approach_that_only_fails(spark):
    scored = spark.createDataFrame([("a", "x", None, "limit")], "approach string, gold string, pred string, error string")
    row = bench.check_summary(scored).first()
    assert (row["n"], row["errors"], row["classes"], row["macro_f1"]) == (0, 1, 0, None)
    assert bench.check_summary(scored.limit(0)).count() == 0


def test_a_text_at_which_the_scorer_raises_fails_alone(spark, tables):
    got = bench.scored_sample(tables[1].filter("category = 'card'"), marks(), 50).collect()
    assert sorted(r["error"] is None for r in got) == [False] + [True] * 12
