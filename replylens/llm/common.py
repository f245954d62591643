"""What the corpus operators share: batches of texts, row keys, connected components.

Cases that hold for every operator of this package unless its docstring says otherwise:
a null text counts as empty; rows that share a ``doc_id`` are one document and share its
decision; a null ``doc_id`` is an id like any other; columns that an operator does not
name are ignored, so their names cannot clash; an empty table gives an empty result with
the same columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.session import materialise, shared_dir

# Bytes of words: digits, letters (upper case made lower) and every byte of a non-ASCII
# character; all other bytes become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128
                   else 32 for b in range(256))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; its lineage ends there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for what is read more than once."""
    return materialise(df, name)


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % modulus).cast("int")


def crc_remainder(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def pieces_of(batches: Iterable[pa.RecordBatch], column: str = "text",
              chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``chars`` bytes of text, one row at least."""
    for batch in batches:
        at = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        total = 0
        for row, size in enumerate(sizes):
            if total and total + size > chars:
                yield batch.slice(at, row - at)
                at, total = row, 0
            total += size
        if at < batch.num_rows:
            yield batch.slice(at)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) per node.

    ``root`` is the smallest node reachable. Alternates the large-star and small-star
    steps: every edge is rehung on the smallest neighbour, from above and from below,
    until nothing changes. A step is a grouped minimum (combined before the shuffle) and
    a join, which adaptive execution splits on a node of high degree. Each round ends in
    a checkpoint.
    """
    now = checkpoint(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    before = None
    while True:
        # large star: larger neighbours of u move to the smallest of u and its neighbours
        least = now.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = (now.selectExpr("b u", "a v").join(least, "u", "left")
                 .selectExpr("v a", "coalesce(m, u) b").distinct())
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = (large.selectExpr("a u", "b v").join(least, "u").filter("v <> m")
                 .selectExpr("v a", "m b")
                 .union(least.selectExpr("u a", "m b")).distinct())
        now = checkpoint(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    pairs = now.selectExpr("a node", "b root")
    return pairs.union(now.selectExpr("b node", "b root").distinct())
