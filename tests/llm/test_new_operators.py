"""Quality rules, whitening and resampling against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from replylens.llm import common, itq, langid, quality, queries, resample, tokencount, warc, whitening

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"


# ---- 11 quality rules

def slow_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered))


def test_measures_equal_brute_force():
    rng = random.Random(3)
    parts = ["a", "b ", "é ", "\n", " ", "\t", "#", "\x0b", "\x0c", "\r", "\x1c", "\x85", "　", "ab ", "a a a a ", "b\n", "!!"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500)]
    found = quality.measure([t.encode() for t in texts])
    at = [quality.MEASURES.index(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    assert [tuple(r) for r in found[:, at].tolist()] == [slow_measures(t) for t in texts]
    assert quality.measure([]).shape == (0, len(quality.MEASURES))


def test_votes_find_planted_accuracies():
    """Independent rules with known accuracies: estimates come near, posteriors follow."""
    rng = np.random.default_rng(5)
    good = rng.random(40_000) < 0.8
    rates = [(0.9, 0.02), (0.8, 0.05), (0.95, 0.01), (0.6, 0.10), (0.85, 0.03)]   # says + of good, says - of good
    says = []
    for plus, minus in rates:
        draw = rng.random(len(good))
        own = np.where(good, draw, 1 - draw)
        says.append(np.where(own < plus, "+", np.where(own < plus + minus, "-", "0")))
        says[-1] = np.where(good, says[-1], np.where(draw < 0.7, "-", np.where(draw < 0.9, "0", "+")))
    patterns = Counter(map("".join, zip(*says)))
    model = quality.fit_votes(patterns)
    assert abs(model.share - 0.8) < 0.03
    for rule, (plus, minus) in enumerate(rates):
        assert abs(model.says[0, rule, 0] - plus) < 0.05 and abs(model.says[1, rule, 1] - 0.7) < 0.06
        assert model.accuracy(rule) > 0.8
    kept = np.array([model.posterior["".join(p)] >= 0.5 for p in zip(*says)])
    assert (kept == good).mean() > 0.97
    assert quality.fit_votes({}).posterior == {}
    assert quality.fit_votes({"+++": 5, "+0+": 1}).posterior == {"+++": 1.0, "+0+": 1.0}


def slow_fit(patterns):
    """The same estimate document by document."""
    docs = [p for p, n in sorted(patterns.items()) for _ in range(n)]
    rules = range(len(docs[0]))
    good = [1.0 if "-" not in p else 1 / (1 + math.exp(3 * p.count("-") - p.count("+"))) for p in docs]
    for _ in range(1000):
        before = good
        total = sum(good)
        share = (total + 1) / (len(docs) + 2)
        rate = lambda j, s, w: (sum(x for p, x in zip(docs, w) if p[j] == s) + 0.01) / (sum(w) + 0.03)
        junk = [1 - g for g in good]
        tables = [{(j, s): rate(j, s, w) for j in rules for s in "+-0"} for w in (good, junk)]
        odds = lambda p: share * math.prod(tables[0][j, p[j]] for j in rules) / (
            (1 - share) * math.prod(tables[1][j, p[j]] for j in rules))
        good = [1.0 if "-" not in p else 1 - 1 / (1 + odds(p)) for p in docs]
        if max(abs(a - b) for a, b in zip(good, before)) < 1e-10:
            break
    return dict(zip(docs, good))


def test_quality_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op11_quality_rules(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    want = slow_fit(Counter(r["votes"] for r in got))
    for r in got:
        own = slow_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == own
        assert r["base_failed"] == (own[0] < 20 or 100 * own[4] > 30 * own[0])
        assert abs(r["posterior"] - want[r["votes"]]) < 1e-6
        assert r["kept"] == (not r["base_failed"] and want[r["votes"]] >= 0.5)


def test_quality_agrees_with_labels(spark):
    found = queries.op11_quality_rules(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    junk = [r for r in found if r["quality"] == 0]
    clean = [r for r in found if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in junk) <= 0.02 * len(junk) and sum(r["kept"] for r in clean) >= 0.99 * len(clean)


def test_quality_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30_000), (None, "one two"), (5, "same\nsame\n"), (5, "same\nsame\n")]
    docs = spark.createDataFrame(rows, KIND).withColumns(dict.fromkeys(["votes", "n_words", "posterior", "kept"], F.lit("x")))
    got = quality.judge_texts(docs).collect()
    assert len(got) == 7 and sum(r["doc_id"] == 5 and r["n_dup_lines"] == 1 for r in got) == 2
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["n_words"] == 0 and by[i]["base_failed"] and not by[i]["kept"] for i in (1, 2, 3))
    assert by[4]["n_repeat_words"] == 30_000 and by[4]["base_failed"]
    assert quality.judge_texts(docs.limit(0)).collect() == []


# ---- 12 whitening

@pytest.mark.parametrize("rows", [
    np.random.default_rng(0).integers(-40, 40, (300, 24)),
    np.random.default_rng(1).integers(0, 2, (200, 6)),              # many equal eigenvalues on the way
    np.repeat(np.eye(8, dtype=int) * 5, 20, axis=0),
    np.outer(np.arange(40), np.ones(5, int)),                       # one direction only
    np.hstack([np.random.default_rng(2).integers(-3, 4, (99, 3)), np.full((99, 4), 7)]),
    np.random.default_rng(3).integers(-9, 9, (4, 30)),              # fewer rows than dimensions
], ids=["full", "binary", "axes", "line", "constant", "few"])
def test_spectrum_equals_decomposition(rows):
    rows = rows.astype(float)
    whole = whitening.Spectrum.empty(rows.shape[1])
    for row in rows:
        whole.add_row(row)
    parts = [whitening.Spectrum.empty(rows.shape[1]) for _ in range(3)]
    for i, row in enumerate(rows):
        parts[i % 3].add_row(row)
    parts[0].merge(parts[1])
    parts[0].merge(whitening.Spectrum.empty(rows.shape[1]))
    parts[0].merge(parts[2])
    off = rows - rows.mean(axis=0)
    want = off.T @ off
    size = max(1.0, np.abs(want).max())
    for got in (whole, parts[0]):
        assert got.n == len(rows) and np.allclose(got.mean, rows.mean(axis=0), atol=1e-12)
        assert np.abs(got.vectors @ np.diag(got.values) @ got.vectors.T - want).max() < 1e-12 * size
        assert np.abs(got.vectors.T @ got.vectors - np.eye(len(got.values))).max() < 1e-12


def test_secular_roots_bracket():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        d = np.sort(rng.random(n) * 10.0 ** rng.integers(-6, 6))
        d += np.arange(n) * 1e-9
        z = rng.standard_normal(n) + 0.01
        pole, x = whitening.secular_roots(d, z)
        roots = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.allclose(d[pole] + x, roots, rtol=1e-12, atol=1e-12 * roots[-1])


def slow_whitening(rows):
    """Per id: exact deviation; and eigenvalues, axes, mean of the distinct rows."""
    exact = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows.items()}
    fit = [list(x) for x in {tuple(x) for x in exact.values()}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    off = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(off.T @ off / n)
    return n, {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in exact.items()}, values[::-1], axes[:, ::-1], {
        i: np.array([(n * c - s) / n for c, s in zip(x, sums)]) for i, x in exact.items()}


def test_whitening_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in table.collect()}
    n, deviation, values, axes, off = slow_whitening(rows)
    got = queries.op12_embedding_whitening(spark, SF).toPandas()
    assert len(got) == 16 * len(rows) and (got["n"] == n).all()
    assert (got["identity_error"] < 1e-12).all()
    for component, own in got.groupby("component"):
        e = values[component - 1]
        assert np.allclose(own["explained"], e / values.sum(), rtol=1e-12)
        want = np.array([off[i] @ axes[:, component - 1] for i in own["vec_id"]]) / math.sqrt(e)
        assert min(np.abs(own["whitened"] - want).max(), np.abs(own["whitened"] + want).max()) < 1e-9
        assert [deviation[i] for i in own["vec_id"]] == own["deviation"].tolist()


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 2.0]), (2, [1.0, 2.0, 0.0]), (3, None), (4, [1.0, None, 0.0]), (5, [nan, 0.0, 0.0]),
            (6, [inf, 0.0, 0.0]), (None, [0.25, -2.0, 3.0]), (7, [-0.0, 0.0, 0.0]), (8, []), (9, [1e30, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        dict.fromkeys(["component", "n", "y", "whitened"], F.lit("x")))
    got = whitening.whiten(table).collect()
    assert {r["vec_id"] for r in got} == {1, 2, None, 7, 8, 9} and {r["n"] for r in got} == {5}
    twice = [r["whitened"] for r in got if r["vec_id"] == 2 and r["component"] == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    tame = whitening.whiten(table.filter("vec_id is null or vec_id <> 9")).collect()
    assert {r["n"] for r in tame} == {4} and max(r["identity_error"] for r in tame) < 1e-12
    assert {r["component"] for r in tame} == {1, 2, 3}
    assert whitening.whiten(table.filter("vec_id = 1")).collect() == []
    assert whitening.whiten(table.limit(0)).collect() == []


def test_whitening_merges_many_parts(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 5)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fit = table.select(whitening.steps(table, "embedding").alias("y")).repartition(30)
    found, sums = whitening.fit_spectrum(fit, 5)
    want = np.floor(np.array([v for _, v in rows]) * 64)
    off = want - want.mean(axis=0)
    assert found.n == 400 and sums == want.sum(axis=0).astype(int).tolist()
    assert np.allclose(found.vectors @ np.diag(found.values) @ found.vectors.T, off.T @ off, rtol=0, atol=1e-6)


# ---- 13 resampling

def slow_resample(docs, items, percent=25, min_words=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    features = lambda w: [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]
    held = [(i, words(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, w in held:
        s.update(features(w))
    for x in items:
        t.update(features(words(x)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, w in held:
        f = features(w)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): n for n, r in enumerate(able[:percent * len(able) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in out]


ORDER = lambda r: tuple((x is None, x or 0) for x in r)


def test_resampling_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = slow_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in items.collect()])
    got = [tuple(r) for r in queries.op13_importance_resampling(spark, SF).collect()]
    assert sorted(got, key=ORDER) == sorted(want, key=ORDER)
    assert sum(r[4] is not None for r in got) > 40


def test_quickselect_finds_every_place(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), rng.choice([None, 1, 2, 3]), i) for i in range(60)]      # many ties, null ids
    table = spark.createDataFrame(rows, "score long, doc_id long, row long")
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for k in (1, 2, 17, 31, 59, 60):
        key = resample.kth_key(table, k, pivots=4)
        assert (key.score, key.doc_id, key.row) == order[k - 1]
    assert resample.kth_key(table, 61) is None and resample.kth_key(table, 0) is None
    ranked = sorted(resample.rank_rows(table).collect(), key=lambda r: r["rank"])
    assert [(r["score"], r["doc_id"], r["row"]) for r in ranked] == order
    assert [r["rank"] for r in ranked] == list(range(1, 61))


def test_resampling_of_awkward_rows(spark):
    long = " ".join(f"w{i % 97}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, "…!?"), (4, long), (None, "a b " * 20), (5, "c d " * 15), (5, "c d " * 15), (6, "Äß Ä " * 30)]
    docs = spark.createDataFrame(rows, KIND).withColumns(dict.fromkeys(["rank", "row", "score", "place"], F.lit("x")))
    items = spark.createDataFrame([("c d e",), (None,)], "text string")
    got = [tuple(r) for r in resample.resample(docs, items, percent=60).collect()]
    assert sorted(got, key=ORDER) == sorted(slow_resample(rows, ["c d e", None], percent=60), key=ORDER)
    assert [r["rank"] for r in resample.resample(docs, items.limit(0), percent=0).collect()] == [None] * 8
    assert resample.resample(docs.limit(0), items).collect() == []


# ---- 5, 6, 7, 10: cases mended since

def test_any_text_is_an_id_of_an_archive(spark):
    """Empty, blank and null ids, line ends and percent signs come back as they were."""
    ids = ["", " s ", "a\nb", "a\r\nb: c", "%41", "é中", None, "plain", "\x00"]
    rows = [(i, "http://x", f"page {n}") for n, i in enumerate(ids)] + [(" t ", None, "same " * 300), ("u\n", None, "same " * 300)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted((r["page_id"] for r in got), key=repr) == sorted((r[0] for r in rows), key=repr)
    revisit = [r for r in got if r["record_type"] == "revisit"]
    assert [(r["page_id"], r["refers_to"]) for r in revisit] == [(" t ", "u\n")]


def test_number_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² ①", "en"), (2, "a ½", "en"), (4, "ein satz", "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert got[1] == "und" and got[2] != "und"


@pytest.mark.parametrize("kind", ["blanks", "line ends", "mixed"])
def test_blanks_by_the_million_have_the_ids_of_fewer(kind):
    encoder = tokencount.encoder(queries.vocabulary("byte_bpe_50k.tiktoken"))
    unit = {"blanks": " ", "line ends": "\n", "mixed": " \n\t\xa0\u3000"}[kind]
    for n in (9_999, 10_000, 30_001):
        run = (unit * n)[:n]
        for text in (run, "a" + run, run + "b", "x" + run + "y 12" + run + ".", "a " + run + "'s"):
            assert encoder.ids(text) == encoder.encoding.encode_ordinary(text)
    text = "a" + (unit * 2_000_000)[:2_000_000] + "b"
    _, starts, ends = encoder.spans(text)
    assert starts[0] == 0 and ends[-1] == len(text)


def planted_vectors(rows, seed=3, shared=0.0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((rows, 64)) + shared
    near = base[rng.integers(0, rows, rows // 4)] + rng.standard_normal((rows // 4, 64)) * 0.3
    return np.vstack([base, near])


@pytest.mark.parametrize("rows,shared", [(400, 0.0), (6400, 0.0), (6400, 0.4)])
def test_links_come_through_codes(spark, monkeypatch, rows, shared):
    """Codes with bits and several tables at every size; recall and components against brute force."""
    plans, plan = [], itq.plan_tables
    monkeypatch.setattr(itq, "plan_tables", lambda *a, **k: plans.append(plan(*a, **k)) or plans[-1])
    data = planted_vectors(rows, shared=shared)
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = itq.link_vectors(table).orderBy("vec_id").toPandas()
    bits, tables, models = plans[0]
    assert bits >= itq.LEAST_BITS and tables > 1 and models
    print("recall", got.n_links.sum() / close.sum(), "bits", bits, "tables", tables)
    assert (got.n_links <= close.sum(axis=1)).all() and got.n_links.sum() >= 0.95 * close.sum()
    if got.n_links.sum() == close.sum():
        label = np.arange(len(data))
        for _ in range(30):
            label = np.minimum(label, np.where(close, label[None, :], len(data)).min(axis=1))
        assert got.component_id.tolist() == label.tolist()


def test_given_tables_are_coded(spark, monkeypatch):
    plans, plan = [], itq.plan_tables
    monkeypatch.setattr(itq, "plan_tables", lambda *a, **k: plans.append(plan(*a, **k)) or plans[-1])
    itq.link_vectors(common.table(spark, "/root/testdata/sf0.01", "embeddings")).count()
    assert plans[0][0] >= itq.LEAST_BITS and plans[0][1] > 1
