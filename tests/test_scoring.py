import math
import time
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from replylens.operators import benchmark as bench
from replylens.operators import gramclassifier as gc
from replylens.operators import joins as jn
from replylens.operators import metrics as me
from replylens.operators import scoring as sc
from replylens.plans import bindings as b
from replylens.plans import load_all
from replylens.plans.registry import QUERIES
from replylens.session import scratch_path
from replylens.sources import results

load_all()


def test_one_bad_row_does_not_stop_the_batch(spark):
    def scorer(pdf):
        if (pdf["id"] == 5).any():
            raise ValueError("boom " + "x" * 500)
        return pd.DataFrame({"pred": pdf["id"].map(str)})
    got = sc.score_batches(spark.range(20).coalesce(1), scorer, "pred string", halve=True).collect()
    bad = [r for r in got if r["error"]]
    assert [r["id"] for r in bad] == [5] and len(bad[0]["error"]) == sc.ERROR_CHARS
    assert sorted(int(r["pred"]) for r in got if not r["error"]) == [i for i in range(20) if i != 5]


def test_a_raising_scorer_is_called_once(spark, tmp_path):
    def scorer(pdf):
        (tmp_path / f"call-{time.time_ns()}").write_text(str(len(pdf)))
        raise ValueError("down")
    got = sc.score_batches(spark.range(20).coalesce(1), scorer, "pred string").collect()
    assert [r["error"] for r in got] == ["ValueError: down"] * 20
    assert [f.read_text() for f in tmp_path.iterdir()] == ["20"]


def test_scorer_may_report_its_own_errors(spark):
    def scorer(pdf):
        return pd.DataFrame({"pred": ["p"] * len(pdf),
                             "error": ["no" if i % 2 else None for i in pdf["id"]]})
    got = sc.score_batches(spark.range(6), scorer, "pred string").collect()
    assert {r["id"]: r["error"] for r in got} == {i: "no" if i % 2 else None for i in range(6)}


def test_errored_verdict_has_no_acceptable(spark):
    df = spark.createDataFrame([(True, True, True, None), (None, None, None, "x")],
                               "grounded boolean, addresses_ask boolean, no_overpromise boolean, "
                               "error string")
    assert [r["acceptable"] for r in sc.judged(df).collect()] == [True, None]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, label string, split string")


def test_fitting_refuses_other_splits(spark):
    df = rows_of(spark, [("1", "a b", "x", "dev"), ("2", "c d", "y", "test")])
    with pytest.raises(Exception, match="expected only dev rows"):
        gc.fit_text_classifier(df)
    one = rows_of(spark, [("1", "a b", "x", "dev")])
    with pytest.raises(ValueError):
        gc.fit_text_classifier(one)


def test_majority_reads_the_split_it_is_given(spark):
    df = rows_of(spark, [(f"d{i}", "t", "playback", "dev") for i in range(5)]
                 + [(f"t{i}", "t", "bug", "test") for i in range(20)])
    assert me.majority_label(jn.of_split(df, "dev"), "label").first()["label"] == "playback"


def test_classifier_features_and_predictions(spark):
    rows = [(f"{i}", "refund the charge please", "billing", "dev") for i in range(4)]
    rows += [(f"b{i}", "the song skips again", "playback", "dev") for i in range(12)]
    rows += [("t1", "refund the chärge", "billing", "test"), ("t2", "song skips", "playback", "test")]
    df = rows_of(spark, rows)
    model = gc.fit_text_classifier(jn.of_split(df, "dev"))
    test = jn.of_split(df, "test")
    got = {r["id"]: r for r in gc.classify_text(model, test).collect()}
    assert got["t1"]["pred"] == "billing" and got["t2"]["pred"] == "playback"
    assert got["t1"]["confidence"] > 0.5
    # Weight of "refund": once in 4 of 16 texts; of "the": once in all of them.
    idf = {r["gram"]: r["idf"] for r in model.grams().collect()}
    assert idf["refund"] == idf["the charge"] == pytest.approx(math.log(17 / 5) + 1)
    assert idf["the"] == pytest.approx(1.0) and "refund the" in idf and "refund charge" not in idf

    again = gc.load_or_fit_classifier(spark, model.path, lambda at: pytest.fail("should be loaded"))
    assert {r["id"]: r["pred"] for r in gc.classify_text(again, test).collect()} == \
        {k: r["pred"] for k, r in got.items()}
    path = scratch_path(spark, "model")
    assert gc.load_or_fit_classifier(spark, path, lambda at: gc.fit_text_classifier(jn.of_split(df, "dev"), path=at)).path == path


def dense_fit(x, labels, weights, classes):
    """The same objective by full Newton steps on dense weights and intercepts."""
    n, d = x.shape
    z = np.hstack([x, np.ones((n, 1))])
    w, target, ridge = np.zeros((d + 1, classes)), np.eye(classes)[labels], np.r_[np.ones(d), 1e-9][:, None]
    for _ in range(60):
        m = z @ w
        p = np.exp(m - m.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = z.T @ (weights[:, None] * (p - target)) + np.r_[np.ones(d), 0.0][:, None] * w
        h = np.einsum("ni,nk,kl,nj->ikjl", z, weights[:, None] * p, np.eye(classes), z) - np.einsum(
            "ni,nk,nl,nj->ikjl", z, weights[:, None] * p, p, z)
        h = h.reshape((d + 1) * classes, -1) + np.diag(np.repeat(ridge[:, 0], classes))
        w -= np.linalg.solve(h, g.ravel()).reshape(w.shape)
    return w


def test_newton_equals_a_dense_fit():
    rng = np.random.default_rng(1)
    for classes in (2, 3):
        x = rng.standard_normal((40, 5))
        x[3] = 0
        labels, weights = rng.integers(0, classes, 40), rng.random(40) * 5
        a, b, gradient, _ = gc.newton(lambda s: x @ (x.T @ s), labels, weights, classes, tol=1e-7)
        want = dense_fit(x, labels, weights, classes)
        assert gradient <= 1e-7 and np.allclose(x.T @ a, want[:-1], atol=1e-6)
        assert np.allclose(b - b.mean(), want[-1] - want[-1].mean(), atol=1e-6)


def test_repeated_texts_count_as_often_as_they_stand(spark):
    rows = [(f"{i}", t, l, "dev") for i, (t, l) in enumerate(
        [("good fine day", "x")] * 30 + [("bad grey day", "y")] * 3 + [("good grey day", "y")] * 2 + [(None, "x"), ("", "y")])]
    df = rows_of(spark, rows)
    model = gc.fit_text_classifier(df.repartition(5), tol=1e-7)
    texts = sorted({(t or "", l) for _, t, l, _ in rows})
    grams = {g["gram"]: g for g in model.grams().collect()}
    assert grams["day"]["idf"] == pytest.approx(math.log(38 / 36) + 1)
    names = sorted(grams)
    x, labels, weights = [], [], []
    for text, label in texts:
        words = text.split()
        v = np.zeros(len(names))
        for g in words + [f"{p} {q}" for p, q in zip(words, words[1:])]:
            v[names.index(g)] = grams[g]["idf"]
        x.append(v / max(np.linalg.norm(v), 1e-300))
        labels.append("xy".index(label))
        n = sum(l == label for _, _, l, _ in rows)
        weights.append(sum((t or "") == text and l == label for _, t, l, _ in rows) * len(rows) / (2 * n))
    want = dense_fit(np.array(x), np.array(labels), np.array(weights), 2)
    got = np.array([grams[g]["weights"] for g in names])
    assert np.allclose(got, want[:-1], atol=1e-5) and model.about()["gradient"] <= 1e-7
    assert gc.classify_text(model, df.limit(0)).count() == 0


def test_the_sample_is_bounded(spark):
    rows = [(f"{i}", f"text word{i}", "ab"[i % 2], "dev") for i in range(400)] + [("r", "the same", "a", "dev")] * 300
    model = gc.fit_text_classifier(rows_of(spark, rows), max_rows=100)
    assert 100 < model.grams().count() < 400


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder of documents of which some 24,000 distinct ones are learned from, more than were once."""
    at = str(tmp_path_factory.mktemp("many"))
    turn = (F.col("id") % 3).cast("int")
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), turn + 1)
    rare = F.concat(F.lit("rare"), F.floor(F.col("id") / 8))          # in eight texts, two or three of them learned from
    text = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("the", "der", "le"))), turn + 1), rare,
                       F.when(F.col("id") % 7 < 4, "often"), F.concat(F.lit("own"), "id"))
    docs = spark.range(80_000).select(F.col("id").alias("doc_id"), text.alias("text"), lang.alias("lang"), F.length(text).alias("n_chars"))
    docs.repartition(5, "doc_id").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_a_stored_model_knows_all_texts(spark, many):
    """F1, brute force: the words in five texts and more, counted over all of them."""
    dev = [r["text"].split() for r in b.answer_key(spark, many).filter("split = 'dev'").select("text").collect()]
    assert len(dev) > 20_000
    df = Counter(w for words in dev for w in set(words))
    got = {r["gram"]: r["idf"] for r in QUERIES["IO9_stored_idf"](spark, many).collect()}
    assert got == {w: pytest.approx(math.log((1 + len(dev)) / (1 + n)) + 1, abs=1e-6) for w, n in df.items() if n >= 5}


def test_class_mass_over_all_texts(spark, many):
    """a fit on fewer rows than it is held against does not give every class the same weight to the hundredth."""
    dev = b.answer_key(spark, many).filter("split = 'dev'").count()
    got = {r["label"]: r["mass"] for r in QUERIES["M2_class_mass"](spark, many).collect()}
    assert got == {x: pytest.approx(dev / 3, abs=0.0101) for x in ("en", "de", "fr")}


def test_external_check_learns_from_all_texts(spark, many, monkeypatch):
    """the classifier beside the scorer knows every word of the training texts."""
    models = []
    fit = bench.fit_text_classifier
    monkeypatch.setattr(bench, "fit_text_classifier", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    got = {r["approach"]: r for r in QUERIES["M2_external_check"](spark, many).collect()}
    key = b.answer_key(spark, many)
    assert got["classifier"]["n"] == key.filter("split = 'test'").count()
    words = Counter(w for r in key.filter("split = 'dev'").select("text").collect() for w in set(r["text"].split()))
    assert {r["gram"] for r in models[0].grams().collect() if " " not in r["gram"]} == {w for w, n in words.items() if n >= 2}


def test_classifier_learns_from_all_texts(spark, many, monkeypatch):
    """a word that two learned texts have counts for the text that is asked."""
    models = []
    fit = gc.fit_text_classifier
    monkeypatch.setattr(gc, "fit_text_classifier", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    got = QUERIES["M2_text_classifier"](spark, many)
    key = b.answer_key(spark, many)
    assert got.count() == key.filter("split = 'test'").count() and got.filter("pred = label").count() == got.count()
    dev = key.filter("split = 'dev'").select("text").collect()
    words = Counter(w for r in dev for w in set(r["text"].split()))
    known = {r["gram"]: r["idf"] for r in models[0].grams().collect() if " " not in r["gram"]}
    assert known == {w: pytest.approx(math.log((1 + len(dev)) / (1 + n)) + 1) for w, n in words.items() if n >= 2}


def test_fit_and_answers_over_many_blocks(spark, monkeypatch):
    """Small blocks of rows and grams give the model and the answers of one block."""
    rows = [(f"{i}", " ".join(f"w{i * k % 23}" for k in range(1, 9)) + " x" * (300 * (i % 40 == 7)), "abc"[i * i % 7 % 3], "dev") for i in range(400)]
    rows += [("none", None, "a", "dev"), ("empty", "", "b", "dev")]
    df = rows_of(spark, rows).repartition(7, "id")
    one = gc.fit_text_classifier(df, min_df=2.0, tol=1e-7)
    want = {r["id"]: r["probabilities"] for r in gc.classify_text(one, df).collect()}
    whole = {r["gram"]: r for r in one.grams().collect()}
    for name, value in (("WORDS", 400), ("LEAST", 1000), ("MOST", 700), ("JUDGED", 900), ("NUMBERS", 256), ("HELD", 0)):
        monkeypatch.setattr(gc, name, value)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        many = gc.fit_text_classifier(df, min_df=2.0, tol=1e-7)
        got = {r["id"]: r["probabilities"] for r in gc.classify_text(many, df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = {r["gram"]: r for r in many.grams().collect()}
    assert parts.keys() == whole.keys()
    assert all(parts[g]["idf"] == pytest.approx(r["idf"]) and parts[g]["weights"] == pytest.approx(r["weights"], abs=1e-5) for g, r in whole.items())
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(p, abs=1e-5) for k, p in want.items())


def test_encoder_vectors_have_unit_length(spark):
    df = spark.createDataFrame([("ab",), ("c",), (None,)], "text string")
    got = sc.encode_text(df, lambda s: [[len(t), 1.0] for t in s]).collect()
    assert [round(sum(x * x for x in r["vector"]), 9) for r in got] == [1.0, 1.0, 1.0]
    hashed = sc.hashed_vectors(df.filter("text is not null"), size=16).collect()
    assert all(len(r["vector"]) == 16 for r in hashed)


def test_baselines(spark):
    items = spark.createDataFrame([("1",), ("2",)], "id string")
    majority = spark.createDataFrame([("playback",)], "label string")
    pairs = spark.createDataFrame([("3", "Hi @a, please DM us 12 /AB"), ("1", "hi , please dm us"),
                                   ("2", "Other")], "brand_reply_id string, brand_reply_text string")
    canned = sc.top_template(pairs)
    assert canned.first()["reply"] == "hi , please dm us"
    near = spark.createDataFrame([("1", "old reply", 0.8)],
                                 "id string, reply string, top_similarity double")
    got = {(r["config"], r["id"]): r for r in sc.baseline_runs(items, majority, canned, near).collect()}
    assert len(got) == 8
    assert got[("trivial_always_escalate", "1")]["escalation_reason"] == "repeat_contact"
    assert got[("canned", "2")]["reply"] == "hi , please dm us"
    assert got[("retrieval_verbatim", "1")]["reply"] == "old reply"
    assert got[("retrieval_verbatim", "2")]["top_similarity"] == 0.0
    assert got[("retrieval_verbatim", "2")]["escalated"] is None
    assert all(r["pred"] == "playback" for r in got.values())


def test_external_benchmark_counts_off_taxonomy_as_wrong(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "nowhere")], "gold string, pred string")
    counts = me.confusion_counts(df)
    assert me.accuracy(counts).first()["acc"] == 0.5
    assert {r["label"] for r in me.label_domain(df).collect()} == {"a", "b", "nowhere"}
    assert [tuple(r) for r in me.confused_pairs(counts).collect()] == [("b", "nowhere", 1)]


def test_a_resumed_run_scores_only_what_is_left(spark, tmp_path):
    def scorer(calls, broken):
        def score(pdf):
            (tmp_path / f"{calls}-{pdf['id'].min()}").write_text(",".join(map(str, pdf["id"])))
            bad = (pdf["id"] % 4 == 0) & broken
            return pd.DataFrame({"pred": pdf["id"].map(str).mask(bad),
                                 "error": bad.map({True: "down", False: None})})
        return score

    def scored(calls):
        return sorted(int(i) for f in tmp_path.glob(f"{calls}-*") for i in f.read_text().split(","))

    path = scratch_path(spark, "resumed")
    items = spark.range(20).coalesce(2)
    sc.score_remaining(items.limit(0), path, "c", 0, scorer("none", False), "pred string")
    sc.score_remaining(items, path, "c", 1, scorer("first", True), "pred string")
    assert scored("none") == [] and scored("first") == list(range(20))
    for calls in ("second", "again"):  # the same run twice leaves the same rows
        sc.score_remaining(items, path, "c", 2, scorer(calls, False), "pred string")
        assert scored(calls) == [0, 4, 8, 12, 16]
        got = {r["id"]: (r["pred"], r["run_ts"]) for r in results.read_results(spark, path).collect()}
        assert got == {i: (str(i), 2 if i % 4 == 0 else 1) for i in range(20)}
    sc.score_remaining(items, path, "other", 2, scorer("other", False), "pred string")
    assert scored("other") == list(range(20))


def test_a_poison_row_fails_alone_in_a_resumed_run(spark):
    def scorer(pdf):
        if (pdf["id"] == 13).any():
            raise RuntimeError("cannot read this one")
        return pd.DataFrame({"pred": pdf["id"].map(str)})

    path = scratch_path(spark, "poison")
    items = spark.range(40).coalesce(1)
    for run_ts in (1, 2):
        sc.score_remaining(items, path, "c", run_ts, scorer, "pred string")
        got = {r["id"]: r["run_ts"] for r in results.read_results(spark, path).collect()}
        assert got == {i: 1 for i in range(40) if i != 13}
    failed = spark.read.parquet(path).filter("error is not null").collect()
    assert [(r["id"], r["error"]) for r in failed] == [(13, "RuntimeError: cannot read this one")] * 2


def test_words_are_looked_at_in_bounded_parts():
    """what a task holds of a batch follows its words; a text with more stands alone."""
    rows = [["a"] * n for n in (3, 0, 2, 9, 1, 4, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["words"])
    parts = [[len(w) for w in p.column(0).to_pylist()] for p in gc._parts(batch, "words", 5)]
    assert parts == [[3, 0, 2], [9], [1, 4], [1]]


def test_grams_are_found_by_numbers():
    """the same grams in the same rows as by their texts, without a text for every pair."""
    rng = np.random.default_rng(3)
    rows = [[f"w{i}" for i in rng.integers(0, 9, n)] for n in rng.integers(0, 8, 60)]
    words = pa.array(rows, pa.list_(pa.string())).slice(5, 50)
    for known in (["w1", "w2 w3", "w0 w0", "w8", "other", "w1 other"], ["w2 w3"], []):
        place, row = gc._Lookup(pa.array(known, pa.string())).of(words)
        want = [(known.index(g), i) for i, r in enumerate(rows[5:55])
                for g in (*r, *map(" ".join, zip(r, r[1:]))) if g in known]
        assert sorted(zip(place.tolist(), row.tolist())) == sorted(want)
