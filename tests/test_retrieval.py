import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from replylens.functions import text as tx
from replylens.operators import bm25, textindex
from replylens.operators import retrieval as rt

VEC = "id long, vector array<float>"


def frame(spark, matrix, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix)], VEC)


def test_identity_vectors(spark):
    eye = frame(spark, np.eye(4))
    own = rt.nearest(eye, eye, 1, "id", "id", exclude_self=False).collect()
    assert all(r["id"] == r["neighbour_id"] and r["similarity"] == 1.0 for r in own)
    other = rt.nearest(eye, eye, 9, "id", "id").collect()
    assert len(other) == 4 * 3
    assert all(r["id"] != r["neighbour_id"] for r in other)


def unit_rows(seed, n, d):
    m = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("block, index_block", [(4096, 65536), (7, 11)])
def test_top_k_with_many_copies(spark, block, index_block):
    """A third of the index is one vector: copies tie exactly and go by id."""
    m = unit_rows(4, 90, 8)
    m[::3] = m[0]
    df = frame(spark, m).repartition(5)
    got = {}
    for r in rt.nearest(df, df, 5, "id", "id", block=block, index_block=index_block).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"], r["similarity"]))
    d = m.astype(np.float64)
    for i in range(len(m)):
        sims = [(-float((d[i] * d[j]).sum()), j) for j in range(len(m)) if j != i]
        want = sorted(sims)[:5]
        assert [(j, s) for _, j, s in sorted(got[i])] == [(j, -s) for s, j in want]


def test_string_ids(spark):
    df = frame(spark, unit_rows(1, 6, 4)).withColumn("id", F.concat(F.lit("k"), "id"))
    got = rt.nearest(df, df, 2, "id", "id")
    assert got.count() == 12 and got.filter("id = neighbour_id").count() == 0


def test_approximate_finds_copies(spark):
    m = unit_rows(2, 120, 16)
    m[60:] = m[:60]
    df = frame(spark, m)
    got = rt.nearest_approx(df, df, 1, "id", "id", block=16, index_block=16)
    hits = {r["id"]: r["neighbour_id"] for r in got.collect()}
    assert all(hits[i] == (i + 60) % 120 for i in range(120))


@pytest.mark.parametrize("spread", [0.1, 5.0])
def test_approximate_recall(spark, spread):
    """Vectors in loose groups, and vectors without any structure."""
    rng = np.random.default_rng(3)
    m = rng.standard_normal((30, 16))[rng.integers(0, 30, 900)] + spread * rng.standard_normal((900, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = rt.nearest_approx(df, df, 4, "id", "id", block=64, index_block=64).collect()
    s = m @ m.T
    np.fill_diagonal(s, -2)
    true = {(i, j) for i, r in enumerate(np.argsort(-s, axis=1)[:, :4]) for j in r.tolist()}
    assert len(got) == 3600 and {r["rank"] for r in got} == {1, 2, 3, 4}
    assert len(true & {(r["id"], r["neighbour_id"]) for r in got}) >= 0.9 * len(true)


def test_approximate_search_of_little(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])],
                               "id long, vector array<double>")
    want = sorted(rt.nearest(df, df, 4, "id", "id").collect())
    assert sorted(rt.nearest_approx(df, df, 4, "id", "id").collect()) == want
    assert rt.nearest_approx(df.limit(0), df, 4, "id", "id").count() == 0
    assert rt.nearest_approx(df, df.limit(0), 4, "id", "id").count() == 0


def test_ordered_lookup(spark):
    cases = spark.createDataFrame([("q", ["c", "a", "zz"]), ("r", ["zz"]), ("s", [])],
                                  "id string, retrieved_ids array<string>")
    index = spark.createDataFrame([(x, f"t{x}", f"r{x}") for x in "abc"],
                                  "tweet_id string, customer_text string, brand_reply string")
    got = {r["id"]: r["evidence"] for r in rt.evidence_by_ids(cases, index).collect()}
    assert [e["tweet_id"] for e in got["q"]] == ["c", "a"]
    assert got["q"][0]["brand_reply"] == "rc" and got["q"][0]["similarity"] is None
    assert got["r"] == got["s"] == []


def test_index_rejects_other_lengths(spark):
    ok = frame(spark, unit_rows(3, 5, 4))
    assert rt.unit_checked(ok).count() == 5
    with pytest.raises(Exception, match="unit length"):
        rt.unit_checked(frame(spark, [[1.0, 1.0]])).collect()


def py_tokens(t):
    out = []
    for w in re.findall(r"[^\W_]+", t.lower()):
        if len(w) > 1 and w not in tx.STOP_WORDS:
            out.append(re.sub(r"(ing|ed|s)$", "", w) or w)
    return out


def py_bm25(query, docs, k):
    toks = [py_tokens(d) for d in docs]
    avg = sum(map(len, toks)) / len(toks)
    found = []
    for i, t in enumerate(toks):
        score = 0.0
        for term in set(py_tokens(query)):
            tf = t.count(term)
            if tf:
                df = sum(term in x for x in toks)
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (
                    tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        if round(score, 3) > 0:
            found.append((-round(score, 3), i))
    return [(i, -s) for s, i in sorted(found)[:k]]


DOCS = ["Audio pauses and skips on the phone", "Billing and refunds for a duplicate charge",
        "Download songs for offline listening on your phone", "Account recovery after a changed email",
        "Songs skipping, songs stopping, phones", "ing ing ing", "the of and"]
QUERIES = ["my phone skips songs", "charged twice, refund", "nothing shared here xyz", "ing"]


@pytest.mark.parametrize("block_docs", [1024, 2, 1])
def test_bm25(spark, block_docs):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    index = textindex.build_index(docs.repartition(3), block_docs=block_docs)
    got = {}
    for r in textindex.search(queries, index, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for i, q in enumerate(QUERIES):
        have = [(d, s) for _, d, s in sorted(got.get(i, []))]
        want = py_bm25(q, DOCS, 4)
        assert [d for d, _ in have] == [d for d, _ in want]
        assert [s for _, s in have] == pytest.approx([s for _, s in want])
    assert 2 not in got


def skewed_texts(n, seed=3):
    """Frequent words everywhere, rare ones in a few texts, ties, empty and null texts."""
    rng = np.random.default_rng(seed)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 20 * n) % 400]
    texts = [" ".join(words[20 * i:20 * i + int(rng.integers(3, 20))]) for i in range(n)]
    texts[5], texts[6], texts[7] = "", texts[8], texts[9]
    return texts


@pytest.mark.parametrize("k", [1, 4, 50])
def test_skipping_loses_nothing(spark, k):
    texts = skewed_texts(600)
    docs = spark.createDataFrame([(f"d{i:04}", t) for i, t in enumerate(texts)] + [("e", None)], "doc_id string, text string")
    asked = [" ".join(t.split()[:6]) for t in texts[::40]] + ["w1", "w1 w2 w3 w399", "", "unknown"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    index = textindex.build_index(docs.repartition(5), block_docs=20)
    got = {}
    for r in textindex.search(queries, index, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((int(r["doc_id"][1:]), r["score"]))
    for i, q in enumerate(asked):
        want = py_bm25(q, [*texts, ""], k)
        assert [d for d, _ in got.get(i, [])] == [d for d, _ in want]
        assert [s for _, s in got.get(i, [])] == pytest.approx([s for _, s in want], abs=1e-9)


def test_small_blocks_cost_no_rows_and_skip_more(spark):
    """rows are those of the spans, however small blocks are; bounds are those of the blocks."""
    docs = spark.createDataFrame(list(enumerate(skewed_texts(1500))), "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(skewed_texts(1500)[::150])], "query_id long, text string")
    whole, fine = (textindex.build_index(docs, block_docs=n) for n in (1024, 16))
    assert whole.table("postings").count() == fine.table("postings").count()
    assert textindex.search(queries, whole).collect() == textindex.search(queries, fine).collect() != []
    least, most = (textindex.search_effort(queries, i).first() for i in (fine, whole))
    assert least["postings"] == most["postings"] and least["pairs"] > 20 * most["pairs"]
    assert least["postings_read"] < most["postings_read"]


def test_a_search_reads_the_index_alone_and_not_all_of_it(spark, tmp_path):
    texts = skewed_texts(2000)
    source = str(tmp_path / "texts")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(source)
    textindex.build_index(spark.read.parquet(source), str(tmp_path / "index"), block_docs=50)
    index = textindex.TextIndex(spark, str(tmp_path / "index"))         # as a later session opens it
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts[::100])], "query_id long, text string")
    found = textindex.search(queries, index, 4)
    assert not [f for f in found.inputFiles() if "texts" in f]
    effort = textindex.search_effort(queries, index, 4).first()
    assert 0 < effort["postings_read"] < 0.5 * effort["postings"]
    assert effort["pairs"] > 20 * 20


def test_copies_of_a_block_serve_many_queries(spark, monkeypatch):
    monkeypatch.setattr(textindex, "QUERIES", 2)
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    queries = spark.createDataFrame([(i, QUERIES[i % 4]) for i in range(9)], "query_id long, text string")
    got = {}
    for r in textindex.search(queries, textindex.build_index(docs), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == {i: [d for d, _ in py_bm25(QUERIES[i % 4], DOCS, 4)] for i in range(9) if i % 4 != 2}


def test_empty_index_and_no_queries(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "songs")], "query_id long, text string")
    assert textindex.search(queries, textindex.build_index(docs), 4).collect() == []
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    assert textindex.search(queries.limit(0), textindex.build_index(docs), 4).collect() == []


def test_live_direction_agrees_with_search(spark):
    passages = spark.createDataFrame([(i, f"K{i}", "", t) for i, t in enumerate(DOCS)],
                                     "ord long, id string, title string, text string")
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "request_id long, message string")
    for r in textindex.passage_evidence(asked, passages).collect():
        want = py_bm25(QUERIES[r["request_id"]], DOCS, 4)
        assert [e["id"] for e in r["evidence"]] == [f"K{d}" for d, _ in want]
        assert [e["score"] for e in r["evidence"]] == pytest.approx([s for _, s in want])


def test_live_direction_takes_any_number_of_passages(spark):
    texts = [f"word{i % 50} topic{i} common" for i in range(2500)]
    passages = spark.createDataFrame([(i, f"K{i}", "", t) for i, t in enumerate(texts)],
                                     "ord long, id string, title string, text string")
    asked = spark.createDataFrame([(1, "topic2400 word0"), (2, None), (3, "nothing here")],
                                  "request_id long, message string")
    got = {r["request_id"]: r["evidence"] for r in textindex.passage_evidence(asked, passages).collect()}
    want = py_bm25("topic2400 word0", texts, 4)
    assert [e["id"] for e in got[1]] == [f"K{d}" for d, _ in want]
    assert got[2] == got[3] == []
    assert [r["evidence"] for r in textindex.passage_evidence(asked, passages.limit(0)).collect()] == [[]] * 3


def test_held_passages_in_bounded_pieces_and_past_their_bound(spark, monkeypatch):
    """The same evidence whether postings are added at once, a few at a time, or from a stored index."""
    passages = spark.createDataFrame([(i, f"K{i}", "", t) for i, t in enumerate(DOCS * 3)],
                                     "ord long, id string, title string, text string")
    asked = spark.createDataFrame([(i, q, [q]) for i, q in enumerate(QUERIES)], "request_id long, message string, more array<string>")
    found = []
    for name, bound in (("CELLS", textindex.CELLS), ("CELLS", 1), ("CELLS", 30), ("HELD_ROWS", 5), ("HELD_TOKENS", 9)):
        with monkeypatch.context() as m:
            m.setattr(textindex, name, bound)
            found.append(sorted(map(tuple, textindex.passage_evidence(asked, passages).collect())))
    assert all(f == found[0] for f in found) and len(found[0]) == 4
    assert [e["id"] for e in found[0][0][3]] == [f"K{d}" for d, _ in py_bm25(QUERIES[0], DOCS * 3, 4)]


def test_own_policy(spark):
    policy = "\n\n".join(DOCS[:5]) + "\n\n" + "long words " * 200
    df = spark.createDataFrame([(0, QUERIES[0], policy), (1, "zzz", policy), (2, "songs", "")],
                               "request_id long, message string, policy string")
    got = {r["request_id"]: r["evidence"] for r in bm25.own_policy_evidence(df).collect()}
    parts = DOCS[:5] + [("long words " * 200)[i:i + 900] for i in range(0, 2200, 900)]
    want = py_bm25(QUERIES[0], [f"Your support policy section {i + 1} {p}" for i, p in
                                enumerate(parts)], 4)
    assert [(e["id"], pytest.approx(e["score"])) for e in got[0]] == \
        [(f"CUSTOM-{i + 1}", s) for i, s in want]
    assert got[1] == got[2] == []


def test_scoring_multiplies_a_bounded_slice(monkeypatch):
    """the vectors of an index block become doubles by the slice, never all at once."""
    m, seen, whole = unit_rows(9, 400, 4), [], rt._matrix
    block = pa.table({"id": pa.array(range(400)), "vector": pa.array(list(m), pa.list_(pa.float32()))})
    ready = rt._prepare(True)(block)
    monkeypatch.setattr(rt, "_matrix", lambda c: seen.append(len(c)) or whole(c))
    monkeypatch.setattr(rt.bt, "CELLS", 400 * 50)
    best = rt.bt.RunningBest(1, 400)
    rt._score(ready, block, best)
    assert max(seen) <= 50 and sum(seen) == 400
    d = m.astype(float) @ m.astype(float).T
    np.fill_diagonal(d, -2)
    assert best.ids.tolist() == d.argmax(axis=1).tolist()


def test_index_blocks_are_bounded_by_their_numbers(spark, monkeypatch):
    """a stored block of the index follows the numbers in it, not its rows alone."""
    made, pack = [], rt.bt.in_blocks
    monkeypatch.setattr(rt.bt, "in_blocks", lambda df, size, *a, **k: made.append(size) or pack(df, size, *a, **k))
    monkeypatch.setattr(rt.bt, "INDEX_VALUES", 80)
    df = frame(spark, unit_rows(5, 60, 8))
    assert rt.nearest(df, df, 2, "id", "id", block=16).count() == 120
    assert made[-1] == 10
