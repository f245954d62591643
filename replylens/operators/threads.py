"""Conversation preparation: replies, the messages they answer, and brand comparison.

Message columns: ``tweet_id, author_id, inbound, created_at, text,
in_response_to_tweet_id``. Ids are compared as normalised text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replylens.functions import text as tx
from replylens.functions.stats import ratio

ELIGIBLE_PAIRS = 15_000


def normalise_messages(messages: DataFrame) -> DataFrame:
    """P1 on both link columns; an empty parent id means no parent."""
    def plain(name: str):
        floating = isinstance(messages.schema[name].dataType, (T.DoubleType, T.FloatType))
        return (tx.float_id if floating else tx.normal_id)(F.col(name))

    return messages.withColumns({
        "tweet_id": plain("tweet_id"),
        "in_response_to_tweet_id": F.nullif(plain("in_response_to_tweet_id"), F.lit(""))})


def brand_replies(messages: DataFrame, brands: Sequence[str]) -> DataFrame:
    """Replies written by the given brands, whatever the case of the author id."""
    wanted = [b.lower() for b in brands]
    return (messages
            .filter(F.lower("author_id").isin(*wanted)
                    & F.col("in_response_to_tweet_id").isNotNull())
            .select(F.lower("author_id").alias("brand"),
                    F.col("tweet_id").alias("brand_reply_id"),
                    F.col("text").alias("brand_reply_text"),
                    F.col("in_response_to_tweet_id").alias("customer_tweet_id"),
                    F.col("created_at").alias("replied_at")))


def root_messages(messages: DataFrame) -> DataFrame:
    """Customer messages that open a thread."""
    return (messages
            .filter(F.col("inbound") & F.col("in_response_to_tweet_id").isNull())
            .select(F.col("tweet_id").alias("customer_tweet_id"),
                    F.col("author_id").alias("customer_author_id"),
                    F.col("text").alias("customer_text"), "created_at"))


# Fixed value: how exported messages write a time, after the day of the week.
WRITTEN_TIME = "MMM dd HH:mm:ss Z yyyy"


def time_order(replies: DataFrame, column: str) -> list[Column]:
    """Sort keys of a time column; a text is read as a time, and comes last if it is none."""
    c = F.col(column)
    if not isinstance(replies.schema[column].dataType, T.StringType):
        return [c]
    after_day = F.regexp_extract(c, r"^[A-Za-z]{3} (.*)$", 1)
    read = F.coalesce(F.try_to_timestamp(F.nullif(after_day, F.lit("")), F.lit(WRITTEN_TIME)),
                      F.try_to_timestamp(c))
    return [read.isNull(), read, c]


def first_replies(replies: DataFrame, time: str = "replied_at", reply_id: str = "brand_reply_id",
                  ) -> DataFrame:
    """The earliest reply of each brand to each message; ties go to the smaller id.

    Ids that are numbers are compared as numbers and come before others.

    A minimum, not a window: it combines on the map side, so a message with a huge
    number of replies sends one row per map task to the shuffle.
    """
    keys = ["brand", "customer_tweet_id"]
    rest = [c for c in replies.columns if c not in keys]
    number = F.col(reply_id).try_cast("decimal(38,0)")
    order = [*time_order(replies, time), number.isNull(), number, F.col(reply_id)]
    first = F.min_by(F.struct(*rest), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)]))
    return replies.groupBy(*keys).agg(first.alias("r")).select(*keys, "r.*")


def reply_pairs(messages: DataFrame, brands: Sequence[str], min_words: int = tx.MIN_WORDS,
                channel: str = tx.PRIVATE_CHANNEL) -> DataFrame:
    """(root customer message, first brand reply) with the substantive flag.

    Replies are reduced to one per message before the join, so the join is one-to-one
    on message id and has no hot key. Ids are normalised first.
    """
    messages = normalise_messages(messages)
    firsts = first_replies(brand_replies(messages, brands))
    return (firsts.join(root_messages(messages), "customer_tweet_id")
            .withColumn("is_substantive",
                        tx.is_substantive(F.col("brand_reply_text"), min_words, channel))
            .drop("replied_at"))


def referenced_parents(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """Messages that some reply points at."""
    wanted = replies.select(F.col("customer_tweet_id").alias("tweet_id")).distinct()
    return messages.join(wanted, "tweet_id", "left_semi")


def usable_pairs(pairs: DataFrame) -> DataFrame:
    """P5: both texts present and the customer side not blank."""
    return pairs.filter(tx.has_text(F.col("customer_text"))
                        & F.col("brand_reply_text").isNotNull())


def indexable_pairs(pairs: DataFrame) -> DataFrame:
    """Only substantive pairs enter an index; an empty result is an error."""
    kept = pairs.filter("is_substantive")
    if kept.isEmpty():
        raise ValueError("no substantive pairs to index")
    return kept


def compare_brands(pairs: DataFrame, by: str = "brand", exact_median: bool = True) -> DataFrame:
    """A1: volume, substantive rate and median reply length per brand.

    The exact median keeps one counter per distinct word count, so its buffer is bounded
    by the longest reply and combines on the map side.
    """
    n_words = tx.word_count(F.col("brand_reply_text"))
    mid = F.median(n_words) if exact_median else F.percentile_approx(n_words, 0.5, 10_000)
    return (pairs.groupBy(by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if("is_substantive").alias("substantive"),
        mid.cast("int").alias("median_reply_words"))
        .withColumn("substantive_rate", ratio(F.col("substantive"), F.col("pairs"))))


def pick_brand(table: DataFrame, by: str = "brand", min_pairs: int = ELIGIBLE_PAIRS) -> DataFrame:
    """A2: best rate among brands with enough pairs, or best of all if none has."""
    return table.orderBy((F.col("pairs") >= min_pairs).desc(), F.desc("substantive_rate"),
                         F.asc(by)).limit(1)


def threshold_sensitivity(pairs: DataFrame, thresholds: Sequence[int], by: str = "brand",
                          channel: str = tx.PRIVATE_CHANNEL) -> DataFrame:
    """Does the brand ranking hold as the minimum word count moves?

    Pairs are first counted by (brand, number of thresholds reached), so the thresholds
    fan out over that small table and never over the pairs.
    """
    cuts = sorted(thresholds)
    n_words = F.coalesce(tx.counted_words(F.col("brand_reply_text")), F.lit(-1))
    open_reply = ~F.coalesce(tx.is_private_channel(F.col("brand_reply_text"))
                             if channel == tx.PRIVATE_CHANNEL
                             else F.col("brand_reply_text").rlike(tx.unicode_rx(channel)),
                             F.lit(True))
    reached = F.when(open_reply, sum((n_words >= c).cast("int") for c in cuts)).otherwise(0)
    counts = (pairs.groupBy(by, reached.alias("reached")).agg(F.count(F.lit(1)).alias("n")))
    fan = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("min_words"))
                              for i, c in enumerate(cuts)]))
    rates = (counts.select(by, "reached", "n", fan.alias("t"))
             .groupBy(by, "t.min_words")
             .agg(F.sum("n").alias("pairs"),
                  F.sum(F.when(F.col("reached") > F.col("t.ord"), F.col("n"))
                        .otherwise(0)).alias("substantive"))
             .withColumn("substantive_rate", ratio(F.col("substantive"), F.col("pairs"))))
    place = Window.partitionBy("min_words").orderBy(F.desc("substantive_rate"), F.asc(by))
    return rates.withColumn("place", F.row_number().over(place))
