"""Turns of conversations in order, although they arrive in any: held until the watermark.

A turn waits until the watermark has passed its time, so that no
earlier one can still come. Then it leaves with what stands before it: how many customer messages, and
the last few turns. A conversation that stays silent long enough leaves no state behind.

Conversations share states, dealt by hash, so a micro-batch costs a few calls per state and not per conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RECENT = 4                  # earlier turns that a turn leaves with
IDLE = "7 days"             # silence after which a conversation's state ends
BUCKETS = 512               # states that conversations share, unless a caller says otherwise
ROWS = 10_000               # released turns that leave at a time
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = {"waiting": "conv_id long, turn long, at long, role string, text string",
         "last": "conv_id long, role string, text string", "sums": "conv_id long, said long, latest long"}
OUT = ("conv_id long, turn long, role string, text string, prior_messages long, "
       "history array<struct<role: string, text: string>>")


class OrderedTurns(StatefulProcessor):
    """State of a bucket of conversations: turns that wait, and what the released ones add up to.

    ``last`` has a conversation's turns in their order. One timer is set at a time, kept in ``alarm``.
    """

    def __init__(self, idle_ms: int, recent: int):
        self.idle_ms, self.recent = idle_ms, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.last, self.sums = (handle.getListState(name, kind) for name, kind in STATE.items())
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            new = [(None if pd.isna(conv) else int(conv), int(turn), int(at), *(None if pd.isna(x) else x for x in rest))
                   for conv, turn, at, *rest in batch[["conv_id", "turn", "at", "role", "text"]].itertuples(index=False)]
            if new:
                self.waiting.appendList(new)
                first = min(t[2] for t in new) if first is None else min(first, *(t[2] for t in new))
        if first is not None:
            self._wake(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def _wake(self, at: int) -> None:
        """Have the timer expire at ``at``, unless it does so earlier."""
        held = self.alarm.get()
        if held is None or at < held[0]:
            if held is not None:
                self.handle.deleteTimer(held[0])
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        said, latest, last, later, out = {}, {}, {}, [], []
        for conv, n, at in self.sums.get():
            said[conv], latest[conv] = n, at
        for conv, role, text in self.last.get():
            last.setdefault(conv, []).append((role, text))
        # by time in a conversation; no two conversations are compared
        for conv, turn, at, role, text in sorted(map(tuple, self.waiting.get()), key=lambda t: (t[1], t[2], str(t[3]), str(t[4]))):
            latest[conv] = max(latest.get(conv, 0), at)
            if at > now:
                later.append((conv, turn, at, role, text))
                continue
            before = last.get(conv, [])
            out.append((conv, turn, role, text, said.get(conv, 0), [{"role": r, "text": t} for r, t in before]))
            said[conv] = said.get(conv, 0) + (role == "user")
            last[conv] = [*before, (role, text)][-self.recent:]
            if len(out) == ROWS:
                yield self._rows(out)
                out = []
        if out:
            yield self._rows(out)
        waits = {t[0] for t in later}
        ended = {conv for conv, at in latest.items() if conv not in waits and now >= at + self.idle_ms}
        kept = [conv for conv in latest if conv not in ended]
        for state, rows in ((self.waiting, later), (self.sums, [(c, said.get(c, 0), latest[c]) for c in kept]),
                            (self.last, [(c, *t) for c in kept for t in last.get(c, ())])):
            state.put(rows) if rows else state.clear()
        self.alarm.clear()
        if kept:
            self._wake(min([t[2] for t in later] + [latest[c] + self.idle_ms for c in kept if c not in waits]))

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "prior_messages", "history"])
        return found.astype({"conv_id": "Int64"})

    def close(self) -> None:
        pass


def in_order(turns: DataFrame, delay: str, idle: str = IDLE, recent: int = RECENT, buckets: int = BUCKETS) -> DataFrame:
    """ST5, ST1: (conv_id, turn, role, text, prior_messages, history) of every turn, in order.

    ``turns`` is a stream of (conv_id, turn, role, text, at); ``at`` is the time of a turn and rises with its
    number. A turn leaves once the watermark, ``delay`` behind the latest time seen, has passed it, and
    one that arrives behind the watermark of the batch before is dropped. ``history`` are the ``recent`` turns before it. State
    ends ``idle`` after the last turn; a conversation resumed later starts anew. A task holds the turns that wait in
    one of ``buckets`` states, which ``delay`` bounds; a stream keeps its number of them.
    """
    spark = turns.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    # turns without a conversation have a state of their own, so that a state's numbers stay whole numbers
    bucket = F.when(F.col("conv_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("conv_id"), F.lit(buckets)))
    slim = turns.select(bucket.alias("bucket"), "conv_id", "turn", "role", "text", F.unix_millis("at").alias("ms"), "at").withWatermark("at", delay)
    return (slim.withColumnRenamed("at", "time").withColumnRenamed("ms", "at").groupBy("bucket")
            .transformWithStateInPandas(OrderedTurns(idle_ms, recent), OUT, "Append", "EventTime"))


def states(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """What a state of ``in_order`` holds after the last batch, by conversation, from its checkpoint."""
    held = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return held.withColumn("key", F.struct("list_element.conv_id"))
