import random

import pytest
from pyspark.sql import functions as F

from replylens.operators import admission as ad
from replylens.operators import history
from replylens.session import scratch_path
from replylens.streaming import triage as tg
from replylens.streaming import turns as tn
from replylens.streaming import usage as us
from test_admission import sequential

SCHEMA = "row long, client string, request_id string, ts long"


def files(spark, df, name, order, n):
    """The rows in n files whose names follow the given order."""
    path = scratch_path(spark, name)
    for part in range(n):
        (df.filter(F.col("_part") == part).drop("_part").coalesce(1).orderBy(order)
         .write.mode("append").parquet(path))
    return path


def stream_of(spark, path, schema):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))


@pytest.mark.parametrize("seed", [1, 2])
def test_admission_over_batches_equals_one_pass(spark, seed):
    rng = random.Random(seed)
    caps = ad.Caps(client_minute=2, client_day=4, all_minute=3, all_day=8, minute=3600)
    start = 19_000 * ad.DAY
    rows = [(i, rng.choice(["hot", "hot", "b", "c"]), f"k{rng.randrange(6)}",
             start + rng.randrange(3 * ad.DAY)) for i in range(240)]
    rows.sort(key=lambda r: (r[3], r[0]))
    df = spark.createDataFrame([(*r, i * 4 // len(rows)) for i, r in enumerate(rows)],
                               SCHEMA + ", _part int")
    path = files(spark, df, "log", "ts", 4)
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    us.admit_stream(stream_of(spark, path, SCHEMA), out, state, scratch_path(spark, "ck"), caps)
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 4
    assert {r["row"]: r["verdict"] for r in got.collect()} == sequential(rows, caps)


TURNS = "conv_id long, turn long, role string, text string, at timestamp"


def arrivals(spark, groups):
    """Each list of (conv_id, turn, role, text, second) as a file of its own, in this order."""
    path = scratch_path(spark, "arrivals")
    for rows in groups:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at long")
        df.withColumn("at", F.timestamp_seconds(F.col("at") + 1_577_836_800)).coalesce(1).write.mode("append").parquet(path)
    return stream_of(spark, path, TURNS)


def test_turns_in_any_order_leave_in_order_and_state_ends(spark):
    """Shuffled over four micro-batches: counts and histories of the batch operators, and no state afterwards."""
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice([None, f"t{t}"]), t * 60) for c in range(12) for t in range(12)]
    mixed = rows[:]
    rng.shuffle(mixed)
    source = arrivals(spark, [mixed[:40], mixed[40:90], mixed[90:], [(-1, 0, "clock", None, 30 * ad.DAY)]])
    out, checkpoint = scratch_path(spark, "ordered"), scratch_path(spark, "ck")
    tg.run_to_files(tn.in_order(source, "1 day"), out, checkpoint)
    got = spark.read.parquet(out).filter("conv_id >= 0")
    turns = spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, role string, text string")
    assert got.count() == len(rows)
    for want, column in ((history.prior_messages(turns), "prior_messages"), (history.recent_turns(turns, 4), "history")):
        assert got.select("conv_id", "turn", column).exceptAll(want.select("conv_id", "turn", column)).count() == 0
    # nothing is left but what the clock's own conversation holds
    for name in ("sums", "waiting", "last"):
        keys = tn.states(spark, checkpoint, name).select("key.conv_id").distinct().collect()
        assert [r[0] for r in keys] in ([], [-1])


def test_turns_wait_for_the_watermark_and_late_ones_are_dropped(spark):
    source = arrivals(spark, [[(1, 2, "user", "c", 120), (1, 0, "user", "a", 0)], [(1, 1, "user", "b", 60)],
                              [(1, 5, "user", "f", 7200)], [(1, 6, "user", "g", 7260)],
                              [(1, 3, "user", "late", 180), (1, 7, "user", "h", 7320)]])
    out, checkpoint = scratch_path(spark, "ordered"), scratch_path(spark, "ck")
    tg.run_to_files(tn.in_order(source, "10 minutes"), out, checkpoint)
    got = [(r["turn"], r["prior_messages"]) for r in spark.read.parquet(out).orderBy("turn").collect()]
    assert got == [(0, 0), (1, 1), (2, 2)]
    waiting = tn.states(spark, checkpoint, "waiting").select("list_element.turn").collect()
    assert sorted(r[0] for r in waiting) == [5, 6, 7]


def test_conversations_share_states(spark):
    """as many states as asked for, whatever the number of conversations; ids stay exact beside a null one."""
    ids = [*range(40), (1 << 60) + 1, None]
    rows = [(c, t, ("user", "assistant")[(t + i) % 2], f"{c} {t}", t * 60) for i, c in enumerate(ids) for t in range(6)]
    mixed = rows[:]
    random.Random(5).shuffle(mixed)
    source = arrivals(spark, [mixed[:100], mixed[100:], [(-1, 0, "clock", None, 3 * 3600)]])
    out, checkpoint = scratch_path(spark, "shared"), scratch_path(spark, "ck")
    tg.run_to_files(tn.in_order(source, "1 hour", buckets=3), out, checkpoint)
    got = spark.read.parquet(out).filter("conv_id >= 0 or conv_id is null").select("conv_id", "turn", "prior_messages", "history")
    turns = spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, role string, text string")
    want = history.prior_messages(turns).join(history.recent_turns(turns, 4).select("conv_id", "turn", "history"),
                                              ["conv_id", "turn"])
    want = want.select("conv_id", "turn", "prior_messages", "history")
    assert got.filter("conv_id is not null").exceptAll(want).count() == want.filter("conv_id is not null").exceptAll(got).count() == 0
    assert [r[0] for r in got.filter("conv_id is null").orderBy("turn").select("prior_messages").collect()] == [0, 0, 1, 1, 2, 2]
    held = spark.read.format("statestore").option("stateVarName", "sums").load(checkpoint)
    # three and the one of turns without a conversation
    assert held.select("key").distinct().count() <= 4
    assert tn.states(spark, checkpoint, "sums").select("key.conv_id").distinct().count() == len(ids) + 1


def test_repeats_and_late_rows(spark):
    base = 1_700_000_000
    rows = [(1, "a", "x", base, 0), (2, "a", "x", base + 60, 0), (3, "b", "x", base + 60, 0),
            (4, "a", "y", base + 3 * ad.DAY, 1), (6, "c", "x", base + 3 * ad.DAY, 2),
            (5, "a", "z", base + 100, 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", _part int").withColumn(
        "ts", F.timestamp_seconds("ts"))
    path = files(spark, df, "reqs", "ts", 4)
    schema = df.drop("_part").schema
    kept = us.drop_repeats(stream_of(spark, path, schema))
    out = scratch_path(spark, "kept")
    tg.run_to_files(kept, out, scratch_path(spark, "ck"))
    got = {(r["client"], r["request_id"]) for r in spark.read.parquet(out).collect()}
    # Row 5 is three days late, behind the watermark of the batch before it.
    assert got == {("a", "x"), ("b", "x"), ("a", "y"), ("c", "x")}
    assert spark.read.parquet(out).count() == 4


def test_stream_triage_equals_batch(spark):
    kind = ("request_id long, message string, history array<struct<role:string,text:string>>, "
            "policy string")
    texts = ["I was hacked", "hi", "mail me at a@b.io about the plan", "x" * 2001,
             "a plain long question", "refund, and my password is hunter2"]
    df = spark.createDataFrame([(i, t, [("user", "call 1234567890123")], None)
                                for i, t in enumerate(texts)], kind)
    path = scratch_path(spark, "asked")
    df.write.parquet(path)
    out = scratch_path(spark, "triaged")
    tg.run_to_files(tg.triage(stream_of(spark, path, df.schema)), out, scratch_path(spark, "ck"))
    batch = {r["request_id"]: r for r in tg.triage(df).collect()}
    live = {r["request_id"]: r for r in spark.read.parquet(out).collect()}
    assert batch == live
    assert [batch[i]["routing"] for i in range(6)] == [
        "human_review", "rejected", "to_draft", "rejected", "to_draft", "human_review"]
    assert batch[2]["message"] == "mail me at [email removed] about the plan"
    assert batch[2]["redacted"] and not batch[4]["redacted"]
    assert batch[0]["history"][0]["text"] == "call [number removed]"


def test_counts_over_batches_equal_one_pass(spark):
    rng = random.Random(6)
    start = 19_000 * ad.DAY
    rows = sorted(((i, rng.choice("aab"), "r", start + rng.randrange(2 * ad.DAY)) for i in range(300)),
                  key=lambda r: r[3])
    df = spark.createDataFrame([(*r, i * 4 // len(rows)) for i, r in enumerate(rows)],
                               SCHEMA + ", _part int")
    timed = df.withColumn("ts", F.timestamp_seconds("ts"))
    path = files(spark, timed, "counted", "ts", 4)
    schema = timed.drop("_part").schema
    want = {(r["scope"], r["client"], r["bucket"]): r["n"] for r in ad.usage_counts(df).collect()}
    got = {}
    for unit, seconds in (("minute", 60), ("day", ad.DAY)):
        out = scratch_path(spark, "counts")
        us.store_counts(us.window_counts(stream_of(spark, path, schema), f"1 {unit}"), out,
                        scratch_path(spark, "ck"))
        stored = spark.read.parquet(out)
        assert stored.select("batch").distinct().count() >= 4
        for r in us.current_counts(stored).collect():
            got[("client" if r["of_client"] else "all") + f"_{unit}", r["client"], r["start"] // seconds] = r["n"]
    assert got == want


def test_repeats_of_keys_that_share_a_state(spark):
    """Many keys, with nulls, over four batches: one state per bucket, the rows of a pass in time order."""
    rng = random.Random(9)
    start = 19_000 * ad.DAY
    rows = sorted(((i, rng.choice([None, *"abcdefgh"]), rng.choice([None, *(f"k{j}" for j in range(9))]),
                    start + rng.randrange(6 * ad.DAY)) for i in range(900)), key=lambda r: (r[3], r[0]))
    df = spark.createDataFrame([(*r, i * 4 // len(rows)) for i, r in enumerate(rows)], SCHEMA + ", _part int").withColumn(
        "ts", F.timestamp_seconds("ts"))
    path = files(spark, df, "shared", "ts", 4)
    out, checkpoint = scratch_path(spark, "kept"), scratch_path(spark, "ck")
    tg.run_to_files(us.drop_repeats(stream_of(spark, path, df.drop("_part").schema), buckets=2), out, checkpoint)
    last, want = {}, set()
    for row, client, request_id, at in rows:
        if at >= last.get((client, request_id), 0) + ad.DAY:
            last[client, request_id] = at
            want.add((row, client, request_id))
    assert {(r["row"], r["client"], r["request_id"]) for r in spark.read.parquet(out).collect()} == want
    assert 0 < spark.read.format("statestore").load(checkpoint).count() <= 8
