"""Importance resampling towards a target: hashed word runs weigh documents, quickselect draws them.

Features of a text are its runs of one to ``longest`` words, hashed into buckets. Counting
buckets is a map-side sum, so what is shuffled is one row per bucket and task. The gain of
a bucket is the logarithm of its share in the target over its share in the documents; the gains are
an array of fixed length that every task holds. A document's weight is the mean gain of its features,
and its score adds Gumbel noise made from its id, so that taking the highest scores draws
without replacement in proportion to exp(weight).

The drawn rows are found by distributed quickselect. Rows have a composite key (score from
high to low, id, row), no two alike. A round picks a few random pivot keys among the rows still
in question, counts in one pass how many rows lie before, at and behind each pivot, and
keeps the interval that holds the wanted place. No row is moved for that; only the rows
before the key found are sorted, in ranges, and numbered by the sizes of the ranges.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import pieces_of, stored, words_of

BUCKETS = 10_000
LONGEST = 2             # words of the longest run
SEED = 7
MIN_WORDS = 20          # documents of fewer words are weighed but never drawn
PIVOTS = 15             # keys held against all rows in one round of the quickselect


def feature_buckets(words: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every run of 1 to ``longest`` words: crc32 of the words joined by a space.

    A run's checksum continues that of the run without its last word.
    """
    runs = list(map(crc32, words))
    found = runs.copy()
    for size in range(2, longest + 1):
        runs = [crc32(b" " + last, run) for last, run in zip(words[size - 1:], runs)]
        found += runs
    return np.array(found, np.int64) % buckets


def count_buckets(texts: DataFrame, text_col: str = "text", longest: int = LONGEST,
                  buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; empty buckets have no row."""
    def run(batches):
        held = np.zeros(buckets, np.int64)
        for batch in pieces_of(batches):
            for text in batch.column("text").to_pylist():
                held += np.bincount(feature_buckets(words_of(text), longest, buckets), minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["bucket", "n"])

    return (texts.select(texts[text_col].alias("text")).mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from the counts of the documents and of the target.

    The gain is 1000 times the natural logarithm of the smoothed shares' ratio, rounded down.
    """
    all_s, all_t = (float(x.agg(F.sum("n")).first()[0] or 0) for x in (source, target))
    own = source.select("bucket", F.col("n").alias("s"))
    wanted = target.select("bucket", F.col("n").alias("t"))
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = ((t + 1) * F.lit(all_s + buckets)) / ((s + 1) * F.lit(all_t + buckets))
    return (source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
            .join(own, "bucket", "left").join(wanted, "bucket", "left")
            .select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")))


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain of each text's features, rounded down."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)        # one number per bucket
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches):
        for batch in pieces_of(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found = feature_buckets(words, longest, len(shared.value))
                rows.append((len(words), len(found),
                             int(shared.value[found].sum()) // len(found) if len(found) else 0))
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """1000 times standard Gumbel noise, rounded down, from sha256 of ``seed:id``; a null id counts as ''."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


@dataclass(frozen=True)
class Key:
    """A place in the order: score from high to low, then id (null last), then row."""
    score: int
    doc_id: object
    row: int

    def before(self) -> Column:
        """Whether a row stands before this place."""
        own = F.col("doc_id")
        if self.doc_id is None:
            smaller, same = own.isNotNull(), own.isNull()
        else:
            smaller = F.coalesce(own < F.lit(self.doc_id), F.lit(False))
            same = F.coalesce(own == F.lit(self.doc_id), F.lit(False))
        level = F.col("score") == self.score
        return (F.col("score") > self.score) | (level & (smaller | (same & (F.col("row") < self.row))))

    def at(self) -> Column:
        return F.col("row") == self.row


def kth_key(rows: DataFrame, k: int, seed: int = SEED, pivots: int = PIVOTS) -> Key | None:
    """The key at place ``k`` (from 1) of ``rows`` (score, doc_id, row); None if there are fewer.

    ``row`` must be unique. Every round reads the rows once for its pivots and once for the
    exact counts; with p pivots about log(rows) / log(p + 1) rounds are needed.
    """
    low: Key | None = None
    high: Key | None = None
    passed = 0              # rows at or before ``low``
    if k < 1:
        return None
    turn = 0
    while True:
        turn += 1
        left = rows
        if low is not None:
            left = left.filter(F.col("score") <= low.score).filter(~low.before() & ~low.at())
        if high is not None:
            left = left.filter(F.col("score") >= high.score).filter(high.before())
        drawn = (left.select("score", "doc_id", "row").orderBy(F.xxhash64(F.lit(seed + turn), "row"), "row")
                 .limit(pivots).collect())
        if not drawn:
            return None
        keys = [Key(r["score"], r["doc_id"], r["row"]) for r in drawn]
        sums = []
        for i, key in enumerate(keys):
            sums += [F.count(F.when(key.before(), 1)).alias(f"before{i}"), F.count(F.when(key.at(), 1)).alias(f"at{i}")]
        counts = left.agg(*sums).first()
        places = sorted((passed + counts[f"before{i}"], counts[f"at{i}"], i) for i in range(len(keys)))
        for before, own, i in places:
            if before < k <= before + own:
                return keys[i]
            if before + own < k:
                low, passed = keys[i], before + own
            else:
                high = keys[i]
                break


def rank_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with their place in the order of the composite key (1, 2, 3 ...).

    Ranges of keys are sorted in their own tasks; a row's place is the size of the ranges
    before its own, one number per task, plus its place there.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranges = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("place", F.monotonically_increasing_id()), "drawn")     # range << 33 | place in it
    own = F.shiftright("place", 33)
    sizes = sorted((r["part"], r["n"]) for r in ranges.groupBy(own.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    starts = rows.sparkSession.createDataFrame(starts, "part long, start long")
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranges.withColumn("part", own).join(F.broadcast(starts), "part")     # one row per task
            .withColumn("rank", F.col("start") + inside + 1).drop("part", "start", "place"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = SEED, min_words: int = MIN_WORDS,
             longest: int = LONGEST, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred (rounded down) are
    drawn: those of the highest scores, smaller ids first where scores tie, a null id after all others.
    Drawn rows are ranked from 1; all others have a null rank. A null or empty text has no
    features and weight 0; an empty target makes every bucket equally wanted. Rows that repeat are
    rows of their own: all are counted, and each may be drawn. Other columns are ignored.
    """
    gains = bucket_gains(stored(count_buckets(docs, text_col, longest, buckets), "source"),
                         stored(count_buckets(target, target_col, longest, buckets), "target"), buckets)
    array = np.zeros(buckets, np.int64)
    for bucket, gain in gains.collect():            # one number per bucket
        array[bucket] = gain
    rows = stored(weigh(docs, array, id_col, text_col, longest)
                  .withColumn("score", F.col("weight") + gumbel("doc_id", seed))
                  .withColumn("row", F.monotonically_increasing_id()), "weighed")
    able = rows.filter(F.col("n_words") >= min_words)
    last = kth_key(able, percent * able.count() // 100, seed)
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(names)
    drawn = (F.col("n_words") >= min_words) & (F.col("score") >= last.score) & (last.before() | last.at())
    return (rank_rows(rows.filter(drawn)).select(names)
            .unionByName(rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long")).select(names)))


def sql(percent: int = 25, seed: int = SEED, min_words: int = MIN_WORDS, buckets: int = BUCKETS) -> str:
    """The query in SQL, for runs of one and two words; crc32 is spelled out over the bytes."""
    words = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             r"'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')")
    return f"""
with byte as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from range(256) r(i)),
w as (select true as own, row_number() over () as no, doc_id, {words} as ws from documents
  union all select false, row_number() over (), null, {words} from benchmark),
f as (select own, no, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])))
  as feature from w),
c as (select own, no, feature, count(*) as n from f group by all),
h as (
  select feature, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint,
      list_transform(range(len(hex(encode(feature))) // 2),
        lambda i: ('0x' || substr(hex(encode(feature)), (2 * i + 1)::int, 2))::bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % {buckets} as bucket
  from (select distinct feature from c), byte),
b as (
  select bucket, coalesce(sum(n) filter (own), 0) as s, coalesce(sum(n) filter (not own), 0) as t
  from c join h using (feature) group by bucket),
z as (select coalesce(sum(s), 0)::double as all_s, coalesce(sum(t), 0)::double as all_t from b),
g as (
  select bucket, floor(1000.0::double * ln(((t + 1)::double * (all_s + {buckets})) / ((s + 1)::double * (all_t + {buckets}))))::bigint as gain
  from b, z),
d as (
  select no, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight
  from c join h using (feature) join g using (bucket) where own group by no),
s as (
  select doc_id, len(ws) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000.0::double * ln(-ln((
      ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double))))::bigint as score
  from w left join d using (no) where own),
r as (
  select *, row_number() over (partition by n_words >= {min_words} order by score desc, doc_id) as place,
    count(*) filter (n_words >= {min_words}) over () as able from s)
select doc_id, n_features, weight, score,
  case when n_words >= {min_words} and place <= {percent} * able // 100 then place::bigint end as rank from r"""
