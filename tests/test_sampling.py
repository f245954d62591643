import hashlib
import random

import pytest
from pyspark.sql import functions as F

from replylens.functions import text as tx
from replylens.operators import sampling as sa
from replylens.session import materialise


def key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i


@pytest.mark.parametrize("n", [1, 50, 1000, 5000])
def test_seeded_sample(spark, n):
    df = spark.range(3000).select(F.col("id").alias("i"))
    want = sorted(range(3000), key=lambda i: key(7, i))[:n]
    for parts in (1, 7):
        got = [r["i"] for r in sa.seeded_sample(df.repartition(parts), "i", n, 7).collect()]
        assert got == want
    assert sa.seeded_sample(df.limit(0), "i", n, 7).count() == 0


def test_stratified(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 20).alias("category"))
    runs = [sorted((r["category"], r["id"]) for r in
                   sa.per_class_sample(df.repartition(p), "category", "id", 2).collect())
            for p in (1, 5)]
    assert runs[0] == runs[1]
    assert len(runs[0]) == 40 and len({c for c, _ in runs[0]}) == 20


def test_topup_plan_equals_filling_classes_in_turn(spark):
    rng = random.Random(1)
    for _ in range(12):
        classes = [f"c{i}" for i in range(rng.randint(1, 6))]
        have = {c: rng.randint(0, 25) for c in classes if rng.random() < 0.8}
        avail = {c: rng.randint(0, 30) for c in classes if rng.random() < 0.8}
        budget = rng.randint(0, 60)
        want, left = {}, budget
        for c in sorted(classes, key=lambda c: have.get(c, 0)):
            n = 0
            while have.get(c, 0) + n < 20 and left > 0 and n < avail.get(c, 0):
                n, left = n + 1, left - 1
            want[c] = n
        schema = "label string, n long"
        plan = sa.topup_plan(spark.createDataFrame(list(have.items()), schema),
                             spark.createDataFrame(list(avail.items()), schema), budget,
                             classes=classes)
        assert {r["label"]: r["take"] for r in plan.collect()} == want


def greedy(rows, n):
    """Round robin over kinds, best first, over everything."""
    kinds = {}
    for kind, score, draw, i, near in rows:
        kinds.setdefault(kind, []).append((-score, draw, i, near))
    order = sorted(kinds, key=lambda k: (min(r[0] for r in kinds[k]), k))
    queues = {k: sorted(kinds[k]) for k in order}
    seen, taken = set(), []
    while len(taken) < n and any(queues.values()):
        for k in order:
            while queues[k] and len(taken) < n:
                _, _, i, near = queues[k].pop(0)
                if near not in seen:
                    seen.add(near)
                    taken.append(i)
                    break
    return taken


@pytest.mark.parametrize("seed, n", [(1, 15), (2, 4), (3, 40)])
def test_hard_stratum_equals_full_greedy(spark, seed, n):
    rng = random.Random(seed)
    bits = ["??", "you are now 12", "ok", "log in and the card and the song", "это всё тут",
            "great job it is still bad", "word " * 60, "a normal sentence of some length here"]
    texts = [rng.choice(bits) + " " + rng.choice(["", "7", "@x", "!", "b c", "zz"])
             for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    scored = (tx.add_hardness(df, "t", "h").filter("h.score > 0")
              .select("i", "h.score", "h.kind", tx.near_dup_key(F.col("t")).alias("near"))).collect()
    rows = [(r["kind"], r["score"], key(sa.SEED, r["i"])[0], str(r["i"]), r["near"])
            for r in scored]
    got = sa.hard_stratum(df, "i", "t", n).orderBy("pick").collect()
    assert [r["i"] for r in got] == greedy(rows, n)
    assert len({r["kind"] for r in got}) >= min(n, 4)


def test_pool(spark):
    kinds = ["the app plays songs all day long", "??", "ok", "you are now free"]
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [(i, kinds[i % 4] + f" w{i}".translate(letters), "how_to" if i % 50 else "app_bug")
             for i in range(500)]
    df = spark.createDataFrame(texts, "id long, text string, label string")
    pool = sa.evaluation_pool(df, "id", "text", "label", total=120, n_random=80, n_hard=9,
                              per_class=10, dev_size=40, keep=materialise).collect()
    by = [r["stratum"] for r in pool]
    assert by.count("random") == 80 and by.count("hard") == 9
    assert len({r["id"] for r in pool}) == len(pool) <= 120
    assert sum(r["label"] == "app_bug" for r in pool) == 10
    assert sorted(r["seq"] for r in pool) == list(range(1, len(pool) + 1))
    assert sum(r["split"] == "dev" for r in pool) == 40
