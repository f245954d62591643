"""Usage limits over a request log.

A request counts only when it is admitted, so admission is a sequential rule. The number
that *can* be admitted is bounded by the caps, though, and everything past that bound can
be dropped before any ordering happens: what is folded in order is small whatever the
volume of the log.

Requests: ``row`` (unique, breaks ties in time), ``client``, ``request_id``, ``ts`` (epoch
seconds).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 256
PUSHED = "spark.sql.optimizer.windowGroupLimitThreshold"
DAY = 86_400


@dataclass(frozen=True)
class Caps:
    """Fixed values by default; a guard of one day against repeated request ids."""
    client_minute: int = 5
    client_day: int = 30
    all_minute: int = 15
    all_day: int = 200
    minute: int = 60

    @property
    def keep_client(self) -> int:
        """Longest useful prefix of one client's minute.

        Inside a minute no cap is ever given back, so once a request is refused by a cap
        all later ones are. Before an admitted request there can only be admitted ones and
        repeats of ids admitted in the last day (two day caps), one per second each.
        """
        return self.client_minute + self.minute * 2 * self.client_day

    @property
    def keep_all(self) -> int:
        """Longest useful prefix of one minute over all clients: admitted requests, repeats,
        and the rows of the few clients that can have reached a cap of their own."""
        capped = self.all_minute // self.client_minute + self.all_day // self.client_day
        return self.all_minute + self.minute * 2 * self.all_day + capped * self.keep_client


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
            salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows per key.

    Up to the session's ``PUSHED`` rows Spark cuts every map task to n per key by itself. Beyond that a
    hot key is cut into ``salts`` parts first: the first n of the parts' first n are the
    first n of the key.
    """
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    if n > int(df.sparkSession.conf.get(PUSHED)):
        df = (df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
              .withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= n)
              .drop("_salt"))
    return (df.withColumn("_rn", F.row_number().over(whole)).filter(F.col("_rn") <= n)
            .drop("_rn"))


def buckets(requests: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """Minute and day numbers of a request."""
    return requests.withColumns({"minute": F.floor(F.col("ts") / caps.minute),
                                 "day": F.floor(F.col("ts") / DAY)})


def admit_per_client(requests: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """The per-client caps alone, as every request with an ``admitted`` flag."""
    timed = buckets(requests, caps)
    per_minute = first_n(timed, ["client", "minute"], ["ts", "row"], caps.client_minute)
    admitted = first_n(per_minute, ["client", "day"], ["ts", "row"], caps.client_day)
    flag = admitted.select("row", F.lit(True).alias("admitted"))
    return (requests.join(flag, "row", "left")
            .withColumn("admitted", F.coalesce("admitted", F.lit(False))))


def usage_counts(requests: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """ST3 in batch: requests per client and minute, client and day, minute, and day."""
    per = (buckets(requests, caps).groupBy("client", "minute", "day")
           .agg(F.count(F.lit(1)).alias("n")))
    every = F.lit(None).cast(requests.schema["client"].dataType).alias("client")
    views = [("client_minute", F.col("client"), F.col("minute")),
             ("client_day", F.col("client"), F.col("day")),
             ("all_minute", every, F.col("minute")), ("all_day", every, F.col("day"))]
    return (per.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("scope"), client.alias("client"), bucket.alias("bucket"),
                 F.col("n").alias("n")) for name, client, bucket in views])).alias("v"))
        .groupBy("v.scope", "v.client", "v.bucket").agg(F.sum("v.n").alias("n")))


def _fold(caps: Caps):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = minute = day = None
        client_minute: dict = {}
        client_day: dict = {}
        all_minute = all_day = 0
        seen: dict = {}
        for pdf in batches:
            taken = []
            for i, (c, client, rid, ts, m, d, settled) in enumerate(zip(
                    pdf["chain"], pdf["client"], pdf["request_id"], pdf["ts"],
                    pdf["minute"], pdf["day"], pdf["settled"])):
                if c != chain:
                    chain, minute, day, seen = c, None, None, {}
                if d != day:
                    day, client_day, all_day = d, {}, 0
                    seen = {k: t for k, t in seen.items() if t + DAY > ts}
                if m != minute:
                    minute, client_minute, all_minute = m, {}, 0
                if not settled and seen.get((client, rid), -DAY) + DAY > ts:
                    continue
                full = (client_minute.get(client, 0) >= caps.client_minute
                        or client_day.get(client, 0) >= caps.client_day
                        or all_minute >= caps.all_minute or all_day >= caps.all_day)
                if full and not settled:
                    continue
                client_minute[client] = client_minute.get(client, 0) + 1
                client_day[client] = client_day.get(client, 0) + 1
                all_minute, all_day = all_minute + 1, all_day + 1
                seen[(client, rid)] = ts
                taken.append(i)
            yield pdf.iloc[taken][["row", "client", "request_id", "ts"]]
    return run


def _day_chains(kept: DataFrame) -> DataFrame:
    """Days that must be folded together: neighbours sharing a (client, id) repeat."""
    ids = kept.select("client", "request_id", "day").distinct()
    before = F.lag("day").over(Window.partitionBy("client", "request_id").orderBy("day"))
    linked = (ids.select("day", (F.col("day") - before == 1).alias("linked"))
              .groupBy("day").agg(F.coalesce(F.max("linked"), F.lit(False)).alias("linked")))
    # One row per calendar day, so this ordering is over the days of the log.
    return linked.select("day", F.sum((~F.col("linked")).cast("int")).over(
        Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("chain"))


def admissions(requests: DataFrame, caps: Caps = Caps(),
               settled: DataFrame | None = None) -> DataFrame:
    """ST4: the admitted requests, at most the daily cap per day.

    Days are independent unless an id repeats across midnight; each run of dependent days
    is one ordered fold over the pruned log, with state no larger than the caps. Rows of
    ``settled`` were admitted earlier; they use up the caps and are returned as well.
    """
    timed = buckets(requests, caps)
    once = (timed.groupBy("client", "request_id", "ts", "minute", "day")
            .agg(F.min("row").alias("row")))
    kept = first_n(once, ["client", "minute"], ["ts", "row"], caps.keep_client)
    kept = first_n(kept, ["minute"], ["ts", "row"], caps.keep_all)
    kept = kept.withColumn("settled", F.lit(False))
    if settled is not None:
        kept = kept.unionByName(buckets(settled, caps).withColumn("settled", F.lit(True)))
    chained = kept.join(F.broadcast(_day_chains(kept)), "day")
    schema = chained.select("row", "client", "request_id", "ts").schema
    return (chained.repartition("chain")
            .sortWithinPartitions("chain", "ts", F.desc("settled"), "row")
            .mapInPandas(_fold(caps), schema))


def with_verdict(requests: DataFrame, admitted: DataFrame) -> DataFrame:
    """ST2, ST4: every request with ``verdict`` admitted, duplicate or usage_limit."""
    admitted = admitted.select("client", "request_id", F.col("row").alias("_row"),
                               F.col("ts").alias("_ts"))
    # Admissions of one id are a day apart, so at most one of them covers a request.
    covers = ((F.col("r.client") == F.col("a.client"))
              & (F.col("r.request_id") == F.col("a.request_id"))
              & (F.col("a._ts") > F.col("r.ts") - DAY)
              & ((F.col("a._ts") < F.col("r.ts"))
                 | ((F.col("a._ts") == F.col("r.ts")) & (F.col("a._row") <= F.col("r.row")))))
    verdict = (F.when(F.col("a._row").isNull(), "usage_limit")
               .when(F.col("a._row") == F.col("r.row"), "admitted").otherwise("duplicate"))
    return (requests.alias("r").join(admitted.alias("a"), covers, "left")
            .select("r.*", verdict.alias("verdict")))


def admit(requests: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """ST4 over a whole log."""
    return with_verdict(requests, admissions(requests, caps))
