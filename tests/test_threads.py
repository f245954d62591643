import pytest
from pyspark.sql import functions as F

from replylens.operators import history, threads
from replylens.sources.readers import MESSAGES

LONG = "Open settings and clear the cache, then sign in again and tell us what you see there"


def messages(spark, rows):
    return threads.normalise_messages(spark.createDataFrame(
        [(i, a, b, str(n), t, None, p) for n, (i, a, b, t, p) in enumerate(rows)], MESSAGES))


def test_pairs(spark):
    df = messages(spark, [
        ("10", "ShopHelp", False, LONG, "20.0"), ("20.0", "u1", True, "the app skips", None),
        ("11", "shophelp", False, "Send us a DM please", "21"), ("21", "u2", True, "paid twice", ""),
        ("12", "ShopHelp", False, LONG, "22"), ("22", "u1", True, "thanks", "10"),
        ("13", "SHOPHELP", False, "second answer " + LONG, "20"),
        ("14", "ShopHelp", False, LONG, "99"), ("15", "ShopHelp", False, LONG, None),
        ("16", "Other", False, LONG, "20")])
    got = {r["customer_tweet_id"]: r for r in threads.reply_pairs(df, ["ShopHelp"]).collect()}
    assert set(got) == {"20", "21"}
    assert (got["20"]["brand_reply_id"], got["20"]["is_substantive"]) == ("10", True)
    assert (got["21"]["brand_reply_id"], got["21"]["is_substantive"]) == ("11", False)
    both = threads.reply_pairs(df, ["ShopHelp", "other"]).collect()
    assert sorted((r["brand"], r["customer_tweet_id"]) for r in both) == [
        ("other", "20"), ("shophelp", "20"), ("shophelp", "21")]


def test_brand_table(spark):
    rows = [("a", True, "x " * 4)] * 3 + [("a", False, "x")] + [("b", True, "y y y")]
    df = spark.createDataFrame(rows, "brand string, is_substantive boolean, brand_reply_text string")
    table = threads.compare_brands(df)
    got = {r["brand"]: r for r in table.collect()}
    assert (got["a"]["pairs"], got["a"]["substantive"], got["a"]["substantive_rate"],
            got["a"]["median_reply_words"]) == (4, 3, 0.75, 4)
    assert threads.pick_brand(table, min_pairs=4).first()["brand"] == "a"
    assert threads.pick_brand(table, min_pairs=100).first()["brand"] == "b"


def test_sensitivity_equals_one_filter_per_threshold(spark):
    rows = [("a" if i % 3 else "b", " ".join(["w"] * (i % 17)) + (" DM" if i % 5 == 0 else ""))
            for i in range(200)]
    df = spark.createDataFrame(rows, "brand string, brand_reply_text string")
    got = {(r["brand"], r["min_words"]): r["substantive"] for r in
           threads.threshold_sensitivity(df, [3, 8, 15]).collect()}
    for cut in (3, 8, 15):
        for brand in "ab":
            want = sum(1 for b, t in rows if b == brand and "DM" not in t and len(t.split()) >= cut)
            assert got[(brand, cut)] == want


def test_no_substantive_pair_is_an_error(spark):
    df = spark.createDataFrame([(False,)], "is_substantive boolean")
    with pytest.raises(ValueError):
        threads.indexable_pairs(df)


@pytest.mark.parametrize("width", [1, 2, 5, 4096])
def test_history_does_not_depend_on_block_width(spark, width):
    import random
    rng = random.Random(3)
    rows = []
    for conv, n in ((1, 23), (2, 1), (3, 8)):
        for turn in sorted(rng.sample(range(60), n)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), f"t{turn}"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    prior = {(r["conv_id"], r["turn"]): r["prior_messages"]
             for r in history.prior_messages(df, width=width).collect()}
    last = {(r["conv_id"], r["turn"]): r["previous_user_text"]
            for r in history.last_user_text(df, width=width).collect()}
    recent = {(r["conv_id"], r["turn"]): [(h["role"], h["text"]) for h in r["history"]]
              for r in history.recent_turns(df, 4, width=max(width, 4)).collect()}
    assert len(prior) == len(last) == len(recent) == len(rows)
    for conv, turn, _, _ in rows:
        before = [r for r in rows if r[0] == conv and r[1] < turn]
        said = [r[3] for r in before if r[2] == "user"]
        assert prior[(conv, turn)] == len(said)
        assert last[(conv, turn)] == (said[-1] if said else None)
        assert recent[(conv, turn)] == [(r[2], r[3]) for r in before[-4:]]


def test_one_long_conversation_is_split(spark):
    """All rows in one conversation: no task may hold more than a block."""
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
                                    .alias("role"), F.lit("x").alias("text"))
    got = history.prior_messages(df, width=500)
    assert got.filter("prior_messages <> cast((turn + 1) / 2 as long)").count() == 0
