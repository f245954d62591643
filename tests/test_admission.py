import random

import pytest

from replylens.operators import admission as ad

SCHEMA = "row long, client string, request_id string, ts long"


def sequential(rows, caps):
    """One request at a time, in order, with counters that expire."""
    used, seen, out = {}, {}, {}
    for row, client, rid, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        m, d = ts // caps.minute, ts // ad.DAY
        if seen.get((client, rid), -ad.DAY) + ad.DAY > ts:
            out[row] = "duplicate"
            continue
        keys = [(("cm", client, m), caps.client_minute), (("cd", client, d), caps.client_day),
                (("am", m), caps.all_minute), (("ad", d), caps.all_day)]
        if any(used.get(k, 0) >= cap for k, cap in keys):
            out[row] = "usage_limit"
            continue
        for k, _ in keys:
            used[k] = used.get(k, 0) + 1
        seen[(client, rid)] = ts
        out[row] = "admitted"
    return out


def verdicts(spark, rows, caps, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return {r["row"]: r["verdict"] for r in ad.admit(df, caps).collect()}


def test_stated_examples(spark):
    now = 1_700_000_040 // 60 * 60
    rows = [(i, "a", f"id{i}", now) for i in range(5)]
    rows += [(5, "a", "more", now), (6, "a", "id0", now)]
    rows += [(10 + i, f"o{i}", f"r{i}", now) for i in range(10)]
    rows += [(30, "new", "n", now), (31, "a", "later", now + 61)]
    got = verdicts(spark, rows, ad.Caps())
    assert [got[i] for i in range(7)] == ["admitted"] * 5 + ["usage_limit", "duplicate"]
    assert all(got[10 + i] == "admitted" for i in range(10))
    assert (got[30], got[31]) == ("usage_limit", "admitted")


def test_day_cap_and_expired_repeat(spark):
    day = 20_000 * ad.DAY
    rows = [(i, "a", f"x{i}", day + i * 61) for i in range(31)]
    rows += [(100, "a", "x0", day + ad.DAY - 1), (101, "a", "x0", day + ad.DAY)]
    got = verdicts(spark, rows, ad.Caps())
    assert [got[i] for i in range(31)] == ["admitted"] * 30 + ["usage_limit"]
    assert (got[100], got[101]) == ("duplicate", "admitted")


@pytest.mark.parametrize("seed", range(4))
def test_four_caps_equal_sequential(spark, seed):
    rng = random.Random(seed)
    caps = ad.Caps(client_minute=2, client_day=4, all_minute=3, all_day=9,
                   minute=rng.choice([60, 3600]))
    start = 19_000 * ad.DAY
    rows = []
    for i in range(600):
        day = rng.choice([0, 0, 1, 2, 5])
        at = start + day * ad.DAY + rng.randrange(0, ad.DAY, rng.choice([600, 1800]))
        client = "hot" if rng.random() < 0.4 else f"c{rng.randrange(6)}"
        rows.append((i, client, f"k{rng.randrange(5)}", at + rng.randrange(3)))
    assert verdicts(spark, rows, caps) == sequential(rows, caps)


def test_hot_client_minute(spark):
    rng = random.Random(9)
    start = 19_000 * ad.DAY
    rows = [(i, "hot", f"k{rng.randrange(900)}", start + rng.randrange(60)) for i in range(3000)]
    rows += [(5000 + i, f"c{i}", "k", start + rng.randrange(120)) for i in range(60)]
    caps = ad.Caps(client_minute=3, client_day=5, all_minute=6, all_day=12)
    assert verdicts(spark, rows, caps) == sequential(rows, caps)


@pytest.mark.parametrize("seed", range(2))
def test_client_caps_equal_sequential(spark, seed):
    rng = random.Random(seed)
    caps = ad.Caps(client_minute=2, client_day=5)
    rows = [(i, rng.choice("aab"), f"r{i}", 19_000 * ad.DAY + rng.randrange(900)) for i in range(200)]
    wide = ad.Caps(client_minute=2, client_day=5, all_minute=10 ** 6, all_day=10 ** 6)
    want = {k: v == "admitted" for k, v in sequential(rows, wide).items()}
    got = ad.admit_per_client(spark.createDataFrame(rows, SCHEMA), caps)
    assert {r["row"]: r["admitted"] for r in got.collect()} == want


@pytest.mark.parametrize("pushed", [0, 1000])
def test_first_n_is_exact_for_a_hot_key(spark, request, pushed):
    request.addfinalizer(lambda: spark.conf.unset(ad.PUSHED))
    spark.conf.set(ad.PUSHED, pushed)
    rows = [(i, "hot" if i % 3 else "cold", f"r{i}", (i * 7919) % 1000) for i in range(900)]
    got = ad.first_n(spark.createDataFrame(rows, SCHEMA), ["client"], ["ts", "row"], 17, salts=5)
    for c in ("hot", "cold"):
        want = sorted((r[3], r[0]) for r in rows if r[1] == c)[:17]
        assert sorted((r["ts"], r["row"]) for r in got.filter(f"client = '{c}'").collect()) == want


def test_usage_counts(spark):
    rows = [(1, "a", "x", 0), (2, "a", "y", 59), (3, "b", "z", 60), (4, "a", "w", ad.DAY)]
    got = {(r["scope"], r["client"], r["bucket"]): r["n"]
           for r in ad.usage_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[("client_minute", "a", 0)] == 2 and got[("all_minute", None, 1)] == 1
    assert got[("client_day", "a", 0)] == 2 and got[("all_day", None, 0)] == 3
