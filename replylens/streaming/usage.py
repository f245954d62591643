"""Usage limits on a stream of requests."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from replylens.operators import admission as ad

BUCKETS = 1024              # states that the keys of a stream of requests share


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a zoned timestamp: a watermark does not accept one without a zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def drop_repeats(requests: DataFrame, delay: str = "24 hours", guard: int = ad.DAY,
                 buckets: int = BUCKETS) -> DataFrame:
    """ST2: a request is dropped if its (client, request_id) was kept within ``guard`` seconds.

    Keys share ``buckets`` states, dealt by hash, so a micro-batch costs a call per bucket and not
    one per key. A state holds the time of the last kept request of each of its keys; a key goes when the
    watermark has passed its guard. Rows of a micro-batch are taken in time order; rows behind the
    watermark are dropped. Unlike ``admit_stream`` this also remembers requests that were
    refused later.
    """
    timed = event_time(requests).withWatermark("ts", delay)
    out = timed.schema
    # nulls have buckets of their own, so that a bucket's numbers stay whole numbers
    bucket = F.pmod(F.xxhash64("client", "request_id"), F.lit(buckets))
    for c in ("client", "request_id"):
        bucket = bucket * 2 + F.col(c).isNull().cast("long")
    timed = timed.withColumns({"_at": F.unix_micros("ts"), "_bucket": bucket,
                               "_key": F.to_json(F.struct("client", "request_id"))})

    def keep(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True)
        rows = rows.sort_values([c for c in ("_at", "row") if c in rows])
        held = dict(state.get[0]) if state.exists else {}
        kept = []
        for i, (own, at) in enumerate(zip(rows["_key"].tolist(), rows["_at"].tolist())):
            last = held.get(own)
            if last is None or at >= last + guard * 1_000_000:
                kept.append(i)
                held[own] = at
        # a key without a time is not remembered
        past = state.getCurrentWatermarkMs() - guard * 1000
        held = {own: int(at) for own, at in held.items() if at // 1000 > past}
        if held:
            state.update((held,))
            state.setTimeoutTimestamp(max(held.values()) // 1000 + guard * 1000)
        elif state.exists:
            state.remove()
        yield rows.iloc[kept][out.fieldNames()]

    return timed.groupBy("_bucket").applyInPandasWithState(
        keep, out, "held map<string, bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def window_counts(requests: DataFrame, width: str, delay: str = "24 hours") -> DataFrame:
    """ST3: requests per tumbling window, per client and, with ``of_client`` false, over all."""
    every = F.lit(None).cast(requests.schema["client"].dataType).alias("client")
    counted = F.explode(F.array(
        F.struct(F.lit(True).alias("of_client"), F.col("client")),
        F.struct(F.lit(False).alias("of_client"), every))).alias("v")
    return (event_time(requests).withWatermark("ts", delay).select("ts", counted)
            .groupBy(F.window("ts", width), "v.of_client", "v.client")
            .agg(F.count(F.lit(1)).alias("n")))


def store_counts(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """ST3: every micro-batch stores the counts it changed, so open windows are seen too.

    A batch writes below its own number; run again it overwrites itself.
    """
    def step(batch: DataFrame, number: int) -> None:
        batch.select(F.unix_seconds("window.start").alias("start"), "of_client", "client",
                     "n").write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    query = (counts.writeStream.outputMode("update").foreachBatch(step)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def current_counts(stored: DataFrame) -> DataFrame:
    """The newest of the stored counts of a window; a count only grows."""
    return stored.groupBy("start", "of_client", "client").agg(F.max("n").alias("n"))


def admit_stream(requests: DataFrame, out: str, state: str, checkpoint: str,
                 caps: ad.Caps = ad.Caps()) -> StreamingQuery:
    """ST4: the four caps and the repeat guard, batch by batch.

    State is what was admitted since two days before the batch, bounded by the daily cap.
    Each batch
    writes its verdicts and the state after it under its own number, so a batch that runs
    again overwrites itself. Batches are expected in time order.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kinds = batch.select("row", "client", "request_id", "ts")
        if number == 0:
            before = spark.createDataFrame([], kinds.schema)
        else:
            oldest = batch.agg(F.min("ts")).scalar() - 2 * ad.DAY
            before = spark.read.schema(kinds.schema).parquet(
                os.path.join(state, f"batch={number - 1}")).filter(F.col("ts") > oldest)
        rows = batch.persist()
        here = os.path.join(state, f"batch={number}")
        admitted = ad.admissions(rows.select(*kinds.columns), caps, before)
        admitted.write.mode("overwrite").parquet(here)
        now = spark.read.schema(kinds.schema).parquet(here)
        ad.with_verdict(rows, now).write.mode("overwrite").parquet(
            os.path.join(out, f"batch={number}"))
        rows.unpersist()

    query = (requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
