"""Streaming queries: the given table as a stream, run until nothing is left."""

from pyspark.sql import functions as F

from replylens.operators import admission as ad
from replylens.plans import bindings as b
from replylens.plans import decide  # noqa: F401  (its SQL is registered before it is used here)
from replylens.plans.registry import SQL, query, table
from replylens.session import scratch_path
from replylens.streaming import triage as tg
from replylens.streaming import turns as tn
from replylens.streaming import usage as us


def stream(spark, sf, name):
    """At most a gigabyte of input per micro-batch, which bounds what one trigger holds.
    The pattern matches a table that is one file and a table that is a folder."""
    schema = table(spark, sf, name).schema
    return (spark.readStream.schema(schema).option("maxBytesPerTrigger", str(1 << 30))
            .parquet(f"{sf}/{name}.parquet*"))


def _run(spark, df, name, **kw):
    path = scratch_path(spark, name)
    tg.run_to_files(df, path, scratch_path(spark, f"{name}-log"), **kw)
    return spark.read.schema(df.schema).parquet(path)


def _arriving(spark, sf, parts=2):
    """Conversations as they may arrive: turns in any order over several micro-batches, one a minute.

    A last file holds the clock's word that time has passed, which is what releases the last turns.
    """
    turns = b.conversations(spark, sf).select("conv_id", "turn", "role", "text")
    longest, count = turns.agg(F.max("turn"), F.count(F.lit(1))).first()
    longest = (longest or 0) + 1
    path = scratch_path(spark, "arriving")
    minute = lambda c: F.timestamp_seconds(c * 60 + 1_577_836_800)  # noqa: E731  from 2020 on
    timed = turns.withColumn("at", minute(F.col("turn")))
    for part in range(parts):
        timed.filter(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(parts)) == part).write.mode("append").parquet(path)
    most = -(-len(spark.read.parquet(path).inputFiles()) // parts)
    clock = spark.range(1).select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast(turns.schema["turn"].dataType).alias("turn"),
                                  F.lit("clock").alias("role"), F.lit(None).cast("string").alias("text"),
                                  minute(F.lit(2 * longest + 20 * 24 * 60)).alias("at"))
    clock.write.mode("append").parquet(path)
    source = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", most).parquet(path)
    # about 4,000 turns a state where there are very many
    found = tn.in_order(source, f"{longest} minutes", buckets=max(tn.BUCKETS, count >> 12))
    return found.filter("conv_id is not null")


@query("ST1_stream_triage", SQL["ST1_batch_triage"])
def stream_triage(spark, sf):
    """Requests with the four turns before them, which the stream's state carries: the rows of the batch."""
    asked = _arriving(spark, sf).filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("message"), "history", F.lit(None).cast("string").alias("policy"))
    done = tg.triage(asked, b.RULES).select(
        "conv_id", "turn", F.md5("message").alias("message_md5"), F.col("verdict.rule").alias("rule"), "routing")
    return _run(spark, done, "triage")


def _timed(spark, sf):
    return stream(spark, sf, "events").select(
        F.col("event_id").alias("row"), F.col("user_id").alias("client"),
        F.get_json_object("props", "$.k").alias("request_id"), "ts")


@query("ST2_drop_repeats", """
with recursive r as (select event_id as "row", user_id as client,
    json_extract_string(props, '$.k') as request_id, epoch_us(ts) as us from events),
kept as (
  select client, request_id, min({'us': us, 'row': "row"}) as k from r group by client, request_id
  union all
  select kept.client, kept.request_id, min({'us': r.us, 'row': r."row"}) as k from kept join r
    on r.client = kept.client and r.request_id = kept.request_id and r.us >= kept.k['us'] + 86400000000
  group by kept.client, kept.request_id, kept.k)
select client, request_id, k['row'] as "row" from kept""")
def _(spark, sf):
    return _run(spark, us.drop_repeats(_timed(spark, sf)), "repeats").select("client", "request_id", "row")


@query("ST3_stream_window_counts", f"""
with {b.REQUESTS}
select 'client_minute' as scope, client, ts // 60 as bucket, count(*) as n from requests group by all
union all select 'client_day', client, ts // 86400, count(*) from requests group by all
union all select 'all_minute', null, ts // 60, count(*) from requests group by all
union all select 'all_day', null, ts // 86400, count(*) from requests group by all""")
def stream_window_counts(spark, sf):
    def counted(unit, seconds):
        path = scratch_path(spark, f"{unit}s")
        us.store_counts(us.window_counts(_timed(spark, sf), f"1 {unit}"), path,
                        scratch_path(spark, f"{unit}s-log"))
        scope = F.when(F.col("of_client"), f"client_{unit}").otherwise(f"all_{unit}")
        return us.current_counts(spark.read.parquet(path)).select(
            scope.alias("scope"), "client", F.floor(F.col("start") / seconds).alias("bucket"), "n")

    return counted("minute", 60).unionByName(counted("day", ad.DAY))


@query("ST5_stream_prior_messages", """
select conv_id, turn, count(*) filter (where role = 'user') over (
  partition by conv_id order by turn rows between unbounded preceding and 1 preceding)
  as prior_messages from conversations""")
def stream_prior_messages(spark, sf):
    return _run(spark, _arriving(spark, sf).select("conv_id", "turn", "prior_messages"), "prior")
