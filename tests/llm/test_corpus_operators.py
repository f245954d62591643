"""Corpus operators against brute force, and on the awkward cases every one must take."""

import hashlib
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from compare import connect, difference
from pyspark.sql import functions as F

import corpus_pipeline
from replylens.llm import (common, decontam, itq, langid, lattice, licenses, linedup, packing,
                           queries, simhash, tokencount, warc)

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def texts_of(spark, rows, kind=KIND):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], kind)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank and very long texts, null id, repeated rows, clashing columns."""
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, LONG), (5, "one two three"), (5, "one two three"),
            (None, "one two three"), (6, "…!?"), (7, "a\nb\na\nb"), (8, "the mit license " * 3)]
    clash = dict.fromkeys(["component_id", "fingerprint", "rank", "word", "block", "key", "bits", "lines",
                           "removed", "spans", "score", "node", "held_out", "sequence_id"], F.lit("x"))
    return texts_of(spark, rows).withColumns(clash)


OPERATORS = {
    "licenses": lambda d: licenses.scan_licenses(d),
    "packing": lambda d: packing.pack_documents(d, queries.vocabulary("word_bpe_49k.json")),
    "linedup": lambda d: linedup.dedup_lines(d),
    "lattice": lambda d: lattice.score_texts(d, queries.vocabulary("piece_bpe_32k.model")),
    "langid": lambda d: langid.identify(d),
    "decontam": lambda d: decontam.find_leaks(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "simhash": lambda d: simhash.group_documents(d),
    "tokencount": lambda d: tokencount.count_tokens(d, queries.vocabulary("byte_bpe_50k.tiktoken")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows_and_empty_tables(odd, name):
    run = OPERATORS[name]
    got = run(odd).collect()
    if name in ("licenses", "linedup", "lattice", "langid", "simhash"):
        assert len(got) == odd.count()
    assert run(odd.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert difference(spark, connect(SF), SF, queries.QUERIES[name], queries.SQL[name]) is None


# ---- 1 licenses

def test_template_regions():
    auto = licenses.compile_template(
        "keep <<beginOptional>>very much<<endOptional>> this <<var;words=1-2;match=[0-9]+>> text")

    def accepts(text):
        return auto.end_from(text.encode().split(), 0) == len(text.split())

    assert accepts("keep this 12 text") and accepts("keep very much this 1 2 text")
    assert not accepts("keep very this 1 text") and not accepts("keep this text")
    assert not accepts("keep this one text") and not accepts("keep this 1 2 3 text")
    with pytest.raises(ValueError):
        licenses.compile_template("<<beginOptional>>all<<endOptional>>")


def test_license_places(spark):
    d = texts_of(spark, [(1, "MIT License, mit license! CC BY-NC 4.0"), (2, "Apache-License 2.0"), (3, None)])
    got = {r["doc_id"]: r for r in licenses.scan_licenses(d).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (9, 3, 0, 4)
    assert got[1]["base_labels"] == "cc-by,mit" and "cc-by-nc" in got[1]["labels"]
    assert got[2]["labels"] == "apache,apache-2.0" and got[2]["score"] == 1.0
    assert (got[3]["n_words"], got[3]["base_labels"], got[3]["first_word"], got[3]["score"]) == (0, "", None, 0.0)


# ---- 2 packing

def test_encoder_equals_library():
    from tokenizers import Tokenizer
    path = queries.vocabulary("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    own = packing.WordEncoder(path)
    rng = random.Random(1)
    parts = ["a", "Bee", "é", "É", " ", "\n", "\x85", "\xa0", "\x1c", "'s", "'LL", "Σ", "ΑΣ", "ſ", "İ", "1", "½",
             "_", "-", "!", "ß", "ﬁ", "中", "́", "<|endoftext|>", "\x00", "　", ","]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert list(own.ids(text)) == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("low,high", [(1, 4095), (1100, 2500), (1300, 1500), (2000, 2100)])
def test_local_search_only_improves(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 400)
    first = packing.best_fit(lengths, 4096)
    fills = lambda bins: sum(int(lengths[b].sum()) ** 2 for b in bins)
    before, n = fills(first), len(first)
    after = packing.local_search(first, lengths, 4096)
    assert len(after) <= n and fills(after) >= before
    assert sorted(i for b in after for i in b) == list(range(400))
    assert all(lengths[b].sum() <= 4096 for b in after)


def test_swaps_empty_a_bin():
    lengths = np.array([6, 4, 7, 3, 5, 5])     # three bins of ten, started badly
    after = packing.local_search([[0, 3], [2], [1], [4], [5]], lengths, 10)
    assert len(after) == 3


def fewest_bins(lengths, size):
    """The optimum by trying every assignment, for a handful of items."""
    best = len(lengths)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(lengths):
            best = len(rooms)
            return
        for b in range(len(rooms)):
            if lengths[at] <= rooms[b]:
                place(at + 1, [*rooms[:b], rooms[b] - lengths[at], *rooms[b + 1:]])
        place(at + 1, [*rooms, size - lengths[at]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_small_cases_against_all_assignments(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(10, 60, 9)
    after = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
    assert len(after) == fewest_bins(lengths.tolist(), 100)


@pytest.mark.parametrize("low,high", [(1000, 2049), (5, 3000)])
def test_search_ends_where_no_step_is_left(low, high):
    lengths = np.random.default_rng(7).integers(low, high, 120)
    bins = packing.local_search([[i] for i in range(120)], lengths, 4096)
    fill = [int(lengths[b].sum()) for b in bins]
    for a, taker in enumerate(bins):
        outs = [(), *((i,) for i in taker), *itertools.combinations(taker, 2)]
        for b, donor in enumerate(bins):
            for item, out in itertools.product(donor if a != b else (), outs):
                gain = int(lengths[item] - sum(lengths[i] for i in out))
                raised = (fill[a] + gain) ** 2 + (fill[b] - gain) ** 2 - fill[a] ** 2 - fill[b] ** 2
                assert not (0 < gain <= 4096 - fill[a] and raised > 0)


def test_packing_is_whole(spark):
    d = common.table(spark, SF, "documents")
    got = packing.pack_documents(d, queries.vocabulary("word_bpe_49k.json")).toPandas()
    own = packing.WordEncoder(queries.vocabulary("word_bpe_49k.json"))
    for r in d.limit(40).collect():
        ids = np.append(own.ids(r["text"]), 1).astype("<u4")
        rows = got[got.doc_id == r["doc_id"]].sort_values("piece")
        assert rows.length.sum() == len(ids) and (rows.length[:-1] == 4096).all()
        for p in rows.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    assert got.doc_id.nunique() == d.count()
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert list(rows.offset) == [0, *rows.length.cumsum()[:-1]] and rows.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) * 1.01 + 1


def test_full_and_repeated_pieces_spread(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    pack_group = packing.pack_group

    def counted(lengths, size):
        sizes.add(int((lengths >= size).sum()) + 10**6 * (len(lengths) > 200))
        return pack_group(lengths, size)

    monkeypatch.setattr(packing, "pack_group", counted)
    rows = [(1, k, 8, k) for k in range(300)] + [(2, 0, 3, 7)] * 400 + [(d, 0, 5, d) for d in range(3, 103)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length int, ids_crc32 long")
    got = packing.pack(pieces, 8, group_rows=100).collect()
    assert sizes.value == 0 and sorted(tuple(r)[:4] for r in got) == sorted(rows)
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in fill.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 8


# ---- 3 line dedup

def brute_lines(docs, min_words):
    """Every window of repeated lines long enough, by comparing texts."""
    lines = {d: [x for x in t.split("\n") if x.strip(" ")] for d, t in docs}
    words = lambda x: len(x.strip(" ").split(" "))
    windows = {}
    for d in sorted(lines):
        own = lines[d]
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if sum(map(words, own[i:j])) >= min_words:
                    windows.setdefault(tuple(own[i:j]), []).append((d, i))
    gone = {d: set() for d in lines}
    for run, places in windows.items():
        first = min(places)
        for d, i in places:
            if d != first[0] or i >= first[1] + len(run):
                gone[d].update(range(i, i + len(run)))
    return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_runs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 5))) for _ in range(9)]
    docs = []
    for d in range(25):
        own = [rng.choice(pool) if rng.random() < 0.8 else f"own {d} {k}" for k in range(rng.randint(0, 14))]
        if rng.random() < 0.3 and own:
            own.insert(rng.randrange(len(own)), "  ")
        docs.append((d, "\n".join(own)))
    want = brute_lines(docs, 8)
    got = {r["doc_id"]: r for r in linedup.dedup_lines(texts_of(spark, docs), 8).collect()}
    for d, text in docs:
        kept, k = [], 0
        for line in text.split("\n"):
            if line.strip(" "):
                if k not in want[d]:
                    kept.append(line)
                k += 1
            else:
                kept.append(line)
        assert got[d]["text"] == "\n".join(kept)
        assert got[d]["n_removed"] == len(want[d])


def test_repeated_rows_do_not_remove_each_other(spark):
    line = " ".join(f"x{i}" for i in range(60))
    d = texts_of(spark, [(1, line), (1, line), (2, line)])
    got = sorted((r["doc_id"], r["n_removed"]) for r in linedup.dedup_lines(d).collect())
    assert got == [(1, 0), (1, 0), (2, 1)]
    kept = linedup.remove_repeats(d).select("doc_id", "n_chars").collect()
    assert sorted(tuple(r) for r in kept) == [(1, len(line)), (1, len(line))]


@pytest.mark.parametrize("blank", ["\t", "\xa0", "\u3000"])
def test_words_parted_by_other_white_space(spark, blank, tmp_path):
    line = blank.join(f"w{i}" for i in range(60))
    d = texts_of(spark, [(1, "a\n" + line), (2, "b\n" + line), (3, f"c\n{blank}one two\nd"), (4, f"e\n{blank}one two\nf")])
    got = linedup.dedup_lines(d).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0, 0, 1]
    d.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(spark, con, str(tmp_path), queries.op3_line_dedup, linedup.sql()) is None


# ---- 4 lattice

def test_lattice_sums_all_segmentations():
    weights = {"▁": -1.0, "a": -2.0, "b": -2.5, "ab": -1.5, "▁a": -1.7, "▁ab": -3.0, "ba": -2.2}
    model = lattice.Lattice(weights, [-4.0] * 256)

    def total(text):
        if not text:
            return 1.0
        out = sum(math.exp(w) * total(text[len(p):]) for p, w in weights.items() if text.startswith(p))
        if text[0] not in weights:
            out += math.exp(-4.0 * len(text[0].encode())) * total(text[1:])
        return out

    for word in ["a", "ab", "abba", "xaé", "ababab", "中"]:
        assert model.word(word) == pytest.approx(math.log10(total("▁" + word)))
    assert math.isfinite(model.word("a" * 20_000))


def test_repeated_and_empty_rows_spread_over_blocks(spark):
    rows = spark.range(20_000).select(F.lit(5).alias("doc_id"), F.lit("same words").alias("text"),
                                      F.lit(False).alias("held_out"))
    sizes = [r["count"] for r in lattice.deal(rows, 20).groupBy("block").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1_300


def test_base_score_by_hand(spark):
    rows = [(i, t) for i, t in enumerate(["The cat", "the dog the", None, "A  cat\n", "zebra", "the", "cat dog",
                                          "x y z", "the the", "dog", "unseen words", "cat"])]
    got = {r["doc_id"]: r for r in lattice.score_texts(
        texts_of(spark, rows), queries.vocabulary("piece_bpe_32k.model"), block_chars=20).collect()}
    words = {i: (t or "").lower().split() + [""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    train = [w for i in words if not held[i] for w in words[i]]
    n, kinds = len(train), len(set(train))
    for i, own in words.items():
        want = sum(math.log10((train.count(w) + 0.1) / (n + 0.1 * (kinds + 1))) for w in own)
        assert got[i]["base_score"] == pytest.approx(want) and got[i]["train_tokens"] == n
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(own), sum(w in train for w in own))
        assert got[i]["held_out"] == held[i] and got[i]["score"] < 0


# ---- 5 WARC

def test_warc_round_trip(spark, tmp_path):
    big = "é" * 50_000
    rows = [(1, "u", "x" * 1000), (2, "u\r\nv", "x" * 1000), (3, None, "y" * 999), (4, "u", "y" * 999), (5, "u", None),
            (6, "u", ""), (7, "u", big), (8, "u", big), (8, "u", big), (9, "u", "WARC/1.1\r\n\r\n" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages, str(tmp_path / "a"), chunk=777).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: by[i]["refers_to"] for i in by if by[i]["record_type"] == "revisit"} == {1: 2, 7: 8}
    archives = warc.write_archives(pages, str(tmp_path / "b"))
    chunks = warc.read_archives(spark, str(tmp_path / "b"), archives, chunk=500).filter("page = '8'")
    whole = b"".join(bytes(r["data"]) for r in sorted(chunks.collect(), key=lambda r: r["chunk"])
                     )
    assert whole in (big.encode(), big.encode() * 2) or len(whole) == 2 * len(big.encode())
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= 500
    assert warc.round_trip(pages.limit(0), str(tmp_path / "c")).collect() == []


# ---- 6 embeddings

def brute_links(vectors, cosine):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(near))
    while True:
        after = np.where(near, label, len(near)).min(axis=1, initial=len(near))
        after = np.minimum(label, after)
        if (after == label).all():
            return near.sum(axis=1), label
        label = after


def test_links_equal_brute_force(spark):
    d = common.table(spark, SF, "embeddings").orderBy("vec_id").toPandas()
    near, label = brute_links(np.stack(d.embedding).astype(float), 0.9)
    got = itq.link_vectors(common.table(spark, SF, "embeddings")).orderBy("vec_id").toPandas()
    assert (got.n_links.to_numpy() <= near).all()
    assert got.n_links.sum() >= 0.9 * near.sum()
    ids = d.vec_id.to_numpy()
    assert (got.component_id.to_numpy() == ids[label]).mean() >= 0.99


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((400, 64))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    rows = np.concatenate([base, 0.901 * base + math.sqrt(1 - 0.901 ** 2) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = itq.link_vectors(df).agg(F.sum("n_links")).first()[0]
    assert 0.9 * 800 <= got <= 800


def test_hot_bucket_is_cut_and_odd_vectors_stand_alone(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(8) * 10
    rows = [(i, (centre + rng.standard_normal(8) * 0.05).tolist()) for i in range(100)]
    rows += [(100, None), (101, [0.0] * 8), (102, [1.0, None] + [0.0] * 6), (103, [float("nan")] * 8),
             (104, []), (105, (-centre).tolist()), (106, (-centre).tolist()), (None, (-centre).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in itq.link_vectors(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["n_links"] == 99 and got[i]["component_id"] == 0 for i in range(100))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(100, 105))
    assert got[106]["n_links"] == 2 and got[None]["component_id"] == 105 and not got[None]["kept"]
    assert itq.link_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [1_500, 8_000])
def test_recall_where_vectors_share_a_direction(spark, rows):
    rng = np.random.default_rng(rows)
    own = rng.standard_normal((rows, 64)) / 8
    near = np.arange(300)
    pull = 0.72         # of the part that is not shared, so that pairs lie just above 0.9
    own[near] = pull * own[near + 300] + math.sqrt(1 - pull ** 2) * own[near]
    shared = np.zeros(64)
    shared[:4] = 0.67
    unit = own + shared
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = int(((unit @ unit.T) >= 0.9).sum()) - rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "vec_id long, embedding array<double>")
    got = itq.link_vectors(df).agg(F.sum("n_links")).first()[0]
    assert want > 200 and 0.96 * want <= got <= want


def test_plan_holds_where_vectors_share_a_direction():
    rng = np.random.default_rng(2)
    shared = np.full(64, 0.8 / 8)
    rows = itq._unit(rng.standard_normal((10_000, 64)) * 0.6 / 8 + shared)
    fresh = itq._unit(rng.standard_normal((3_000, 64)) * 0.6 / 8 + shared)
    for total in (3_000, 200_000, 20_000_000):
        bits, tables, models = itq.plan_tables(total, rows[:8192], rows[8192:], 0.9)
        for a, b in itq.moved_pairs(fresh, 0.9, seed=7):
            same = itq.substrings(a, models, bits, tables) == itq.substrings(b, models, bits, tables)
            assert same.any(axis=1).mean() >= 0.97


# ---- 7 language

def test_sample_is_the_smallest_draws(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, "aa").when(F.col("id") % 300 == 0, "cc")
                                      .otherwise("bb").alias("lang"), F.xxhash64("id").alias("draw"))
    got = sorted(map(tuple, langid.smallest_draws(rows, 250).collect()))
    by_lang: dict = {}
    for lang, draw in rows.collect():
        by_lang.setdefault(lang, []).append(draw)
    assert got == sorted((lang, d) for lang, all_ in by_lang.items() for d in sorted(all_)[:250])


def test_held_out_accuracy_and_lang_is_no_input(spark):
    d = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit_languages(d)
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    blind = langid.predict_languages(d.withColumn("lang", F.lit("xx")), model).orderBy("doc_id").limit(50).collect()
    assert blind == langid.predict_languages(d, model).orderBy("doc_id").limit(50).collect()


def test_no_letter_is_undetermined(spark, odd):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd).collect()}
    assert [got[i] for i in (1, 2, 3, 6)] == ["und"] * 4 and got[4] == "en"


def test_repeated_rows_are_learned_from_once(spark, monkeypatch):
    sizes, fit = [], langid.Votes.fit
    monkeypatch.setattr(langid.Votes, "fit", lambda names, rows, labels: sizes.append(len(rows)) or fit(names, rows, labels))
    rows = [(1, "same words again", "en", "s", 16)] * 300
    rows += [(i, f"text number {i}", lang, "s", 14) for i in range(2, 60) for lang in ("en", "de")]
    langid.fit_languages(spark.createDataFrame(rows, KIND).repartition(8), per_language=10**6)
    kept = [i for i in range(2, 60) if common.crc_remainder(i, 4) != 2]
    assert max(sizes) == 2 * len(kept) + (common.crc_remainder(1, 4) != 2) < 200
    sizes.clear()
    langid.fit_languages(spark.createDataFrame(rows, KIND), per_language=20)
    assert max(sizes) == 40


# ---- 8 decontamination

def brute_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        after = [i]
        for j, x in enumerate(words, 1):
            after.append(min(row[j - 1] + (w != x), row[j] + 1, after[-1] + 1))
        row = after
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    items = [(t, " ".join(f"v{rng.randrange(300)}" for _ in range(n)))
             for t, n in enumerate([1, 3, 5, 9, 14, 20, 33, 50, 50])]
    docs = []
    for d in range(60):
        words = [f"u{rng.randrange(300)}" for _ in range(rng.randint(0, 80))]
        own = rng.choice(items)[1].split(" ")
        for _ in range(rng.randrange(len(own) // 4 + 1)):
            at = rng.randrange(len(own))
            own[at:at + 1] = rng.choice([[], ["zz"], [own[at], "yy"]])
        at = rng.randint(0, len(words))
        docs.append((d, " ".join(words[:at] + own + words[at:]).upper() + "."))
    want = {}
    for d, text in docs:
        for t, item in items:
            own = item.split(" ")
            edits = brute_distance(own, text.lower().rstrip(".").split())
            if edits <= decontam.edits_allowed(len(own), 0.8):
                want[d, t] = edits
    kind = "item_id long, text string"
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.find_leaks(
        texts_of(spark, docs), spark.createDataFrame([*items, (99, None), (98, "!")], kind)).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 20
    assert all(got[k] == want[k] for k in got)


def test_long_items_are_found_at_all_edits(spark):
    rng = np.random.default_rng(4)
    items, docs, group = [], [], {}
    for n in (60, 100, 200, 400):
        for how in ("substitute", "delete", "insert", "mix"):
            for _ in range(12):
                item = [f"v{w}" for w in rng.integers(3000, size=n)]
                own, key = list(item), len(items)
                for at in sorted(rng.choice(n, decontam.edits_allowed(n, 0.8), replace=False).tolist(), reverse=True):
                    one = rng.choice(["substitute", "delete", "insert"]) if how == "mix" else how
                    own[at:at + 1] = {"substitute": ["zz"], "delete": [], "insert": ["yy", own[at]]}[one]
                items.append((key, " ".join(item)))
                docs.append((key, " ".join(["u"] * int(rng.choice([0, 50])) + own + ["u"] * 50)))
                group[key] = n, how
    got = decontam.find_leaks(texts_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = [group[r["doc_id"]] for r in got if r["doc_id"] == r["item_id"]]
    assert {key: found.count(key) for key in group.values() if found.count(key) < 11} == {}
    assert all(r["end_word"] <= len(docs[r["doc_id"]][1].split()) for r in got)


# ---- 9 SimHash

def test_fingerprint_by_hand():
    def slow(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for text in [None, "", "a", "a b", "a b c", "A b C d e f g a b c", "é É ß x y"]:
        assert simhash.fingerprint(text) == slow(text)


def test_links_of_fingerprints_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(150)]
    for v in values[:60] + values[:5] * 8:
        for _ in range(rng.randrange(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    close = [[bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 3 for b in values] for a in values]
    label = list(range(len(values)))
    for _ in values:
        label = [min(label[j] for j in range(len(values)) if close[i][j]) for i in range(len(values))]
    want = {v: values[label[i]] for i, v in enumerate(values)}
    got = dict.fromkeys(values)
    got |= {r["bits"]: r["root"] for r in simhash.link_fingerprints(
        spark.createDataFrame([(v,) for v in values], "bits long")).collect()}
    assert {v: (r if r is not None else v) for v, r in got.items()} == want


def test_empty_texts_are_one_group(odd):
    got = {r["doc_id"]: r for r in simhash.group_documents(odd).collect()}
    assert {got[i]["component_id"] for i in (1, 2, 3)} == {1} and got[1]["fingerprint"] == "0" * 16
    assert got[None]["component_id"] == 5


# ---- 10 token counts

@pytest.mark.parametrize("rule", ["start", "most", "split"])
def test_sections_add_up(rule):
    enc = tokencount.ByteEncoder(queries.vocabulary("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["word", " ", "\n", "é", "中文", "!", "straße", "🙂"]) for _ in range(rng.randint(0, 30)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.randint(0, 6))))
        spans = list(zip(cuts[:-1], cuts[1:]))
        if len(spans) > 2:
            del spans[1]
        ids, starts, ends = enc.spans(text)
        counts, _ = tokencount.share_out(starts, ends, spans, rule)
        assert counts.sum() == pytest.approx(len(ids))
        slow = np.zeros(len(spans) + 1)
        for s, e in zip(starts, ends):
            held = [next((k for k, (a, b) in enumerate(spans) if a <= c < b), len(spans)) for c in range(s, e)]
            if rule == "start":
                slow[held[0]] += 1
            elif rule == "most":
                slow[max(dict.fromkeys(held), key=held.count)] += 1
            else:
                for k in held:
                    slow[k] += 1 / len(held)
        assert counts == pytest.approx(slow)


def test_spans_equal_the_other_library():
    from tokenizers import Tokenizer
    enc = tokencount.ByteEncoder(queries.vocabulary("byte_bpe_50k.tiktoken"))
    other = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    for text in ["plain text, two  lines\nhere", "straße é 中文 end"]:
        want = other.encode(text, add_special_tokens=False)
        ids, starts, ends = enc.spans(text)
        assert list(ids) == want.ids
        if text.isascii():
            assert [t.strip() for t in (text[s:e] for s, e in zip(starts, ends))] == \
                [text[s:e].strip() for s, e in want.offsets]


# ---- pipeline

def test_pipeline_stages(spark, odd):
    line = " ".join(f"q{i}" for i in range(70))
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, line + "\nown first"), (2, "own second\n" + line), (3, "near " + line[::-1]),
            (4, "near " + line[::-1]), (5, "some " + item + " more"), (6, None), (7, "?!"), (8, line)]
    docs = texts_of(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 8]
    kept = stages["line_dedup"](spark, kept, SF)
    assert {r["doc_id"]: r["text"] for r in kept.collect()}[2] == "own second"
    assert 8 not in {r["doc_id"] for r in kept.collect()} and kept.columns == docs.columns
    kept = stages["near_dedup"](spark, docs.filter("doc_id in (3, 4, 5)"), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
        stage(spark, odd, SF).collect()


def test_language_stage_without_labels(spark, odd):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    got = [r["doc_id"] for r in stage(spark, unlabelled, SF).collect()]
    assert len(got) == 6 and set(got) == {4, 5, 7, 8, None}


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns
