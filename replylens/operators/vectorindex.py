"""Exact vector search over one byte per component.

A stored index has two tables. ``codes`` holds every vector rounded to one byte per component,
with its scale and the length of what the rounding took away. By that length the true product
with a query lies within a known distance of the product with the code. A search scans the
codes alone and keeps what may be among the best k by these bounds; only that, a few rows a
query, is read from ``exact`` and scored in full. Nothing is lost, whatever the vectors look like:
there are no cells that a neighbour could lie outside of.

``exact`` is stored in ranges of the id with small row groups, so that reading a few ids skips most
of it.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from replylens.functions import vectors as vx
from replylens.operators import blocktopk as bt
from replylens.operators.retrieval import _matrix
from replylens.session import materialise, scratch_path

QUERIES = 4096              # queries that one scan of the codes serves
ROWS = 65_536               # codes of a block, where both sides are cut into blocks
GROUP_BYTES = 1 << 20       # of a row group of the exact vectors
RANGES = 64                 # id ranges that are asked for, at most


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, name))


def quantise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, errors) of the rows: ``|q·x - scale * q·code| <= error * |q|`` for every q.

    The error covers what rounding takes away and the rounding of single-precision products.
    """
    scales = (np.abs(matrix).max(axis=1, initial=0) / 127).astype(np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        codes = np.where(scales[:, None] > 0, np.rint(matrix / scales[:, None].astype(float)), 0)
    codes = np.clip(codes, -127, 127).astype(np.int8)
    near = codes * scales[:, None].astype(float)
    lost = np.linalg.norm(matrix - near, axis=1)
    single = np.linalg.norm(near, axis=1) * (matrix.shape[1] + 2) * 2.0 ** -23
    return codes, scales, np.nextafter(((lost + single) * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))


def build_vector_index(vectors: DataFrame, path: str | None = None, row_id: str = "tweet_id",
                       vector: str = "vector") -> VectorIndex:
    """Store both tables of ``vectors`` below ``path``.

    Null vectors are left out; one with a null, infinite or missing-number component stops the job. All
    must have the same length.
    """
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "vectorindex")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (vectors.select(F.col(row_id).alias("id"), F.col(vector).alias("vector")).filter("vector is not null")
            .filter(F.when(F.coalesce(finite, F.lit(False)), True).otherwise(
                F.raise_error(F.lit("index vector has a component that is no number")).cast("boolean"))))
    (rows.repartitionByRange("id").sortWithinPartitions("id").write.option("parquet.block.size", GROUP_BYTES)
     .parquet(os.path.join(path, "exact")))
    exact = VectorIndex(spark, path).table("exact")
    out = T.StructType([exact.schema["id"], T.StructField("code", T.BinaryType()),
                        T.StructField("scale", T.FloatType()), T.StructField("error", T.FloatType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            codes, scales, errors = quantise(_matrix(batch.column("vector")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([row.tobytes() for row in codes], pa.binary()),
                 pa.array(scales), pa.array(errors)], schema=arrow)

    exact.mapInArrow(run, out).write.parquet(os.path.join(path, "codes"))
    return VectorIndex(spark, path)


class _Bounds:
    """Queries and, for each, the rows seen whose upper bound reaches the k-th lower bound.

    Everything is held for queries of length one, and a product with the last component added gives the upper
    bound itself.
    """

    def __init__(self, block: pa.Table, k: int, exclude_self: bool):
        self.keys, self.k = block.column(0), k
        self.own = np.argsort(bt.as_numpy(self.keys), kind="stable") if exclude_self else None
        self.sorted = bt.as_numpy(self.keys)[self.own] if exclude_self else None
        q = _matrix(block.column(1))
        self.norm = np.linalg.norm(q, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            q = q / np.where(self.norm > 0, self.norm, 1)[:, None]
        # nothing is known of products with an infinite query
        far = np.isinf(self.norm)
        q[far] = 0
        self.q = np.c_[q, np.where(far, np.inf, 1)].astype(np.float32)
        self.lows = np.full((len(self.q), k), -np.inf, np.float32)
        self.floor = self.lows.min(axis=1)
        self.rows, self.ids = np.empty(0, np.int64), None
        self.high, self.low = np.empty(0, np.float32), np.empty(0, np.float32)

    def add(self, batch) -> None:
        ids = bt.as_numpy(batch.column("id"))
        data = batch.column("code")
        data = data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data
        codes = np.frombuffer(b"".join(data.to_pylist()), np.int8).reshape(len(ids), -1)
        scale, error = (bt.as_numpy(batch.column(c)) for c in ("scale", "error"))
        # single precision of the query itself, and of the sums that hold the reach
        size = codes.shape[1]
        reach = (error.astype(float) + 2.0 ** -22 * 127 * scale * np.sqrt(size)) * (1 + (size + 4) * 2.0 ** -21)
        reach = np.nextafter(reach.astype(np.float32), np.float32(np.inf))
        step = max(1, bt.CELLS // len(self.q))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            near = codes[part].astype(np.float32) * scale[part, None]
            self._add(ids[part], np.c_[near, reach[part]], reach[part])

    def _add(self, ids, near, reach) -> None:
        with np.errstate(invalid="ignore", over="ignore"):
            high = self.q @ near.T
        if self.own is not None:
            at = np.minimum(np.searchsorted(self.sorted, ids), len(self.sorted) - 1)
            same = np.flatnonzero(self.sorted[at] == ids)
            high[self.own[at[same]], same] = -np.inf
        # a floor for queries that have none yet; the others are only compared
        new = np.flatnonzero(np.isneginf(self.floor))
        floor = self.floor.copy()
        if len(new):
            top = min(self.k, len(ids))
            low = self._low(high[new], reach[None, :])
            best = np.partition(low, len(ids) - top, axis=1)[:, len(ids) - top:]
            floor[new] = np.partition(np.hstack([self.lows[new], best]), top, axis=1)[:, top:].min(axis=1)
        rows, cols = np.nonzero((high >= floor[:, None]) & (high > -np.inf))
        if not len(rows):
            return
        up = high[rows, cols]
        down = self._low(up, reach[cols])
        # what can raise a floor is among the rows found
        hit = np.unique(rows)
        owner = np.r_[np.repeat(hit, self.k), rows]
        value = np.r_[self.lows[hit].ravel(), down]
        order = np.lexsort((-value, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        self.lows[hit] = value[order][place < self.k].reshape(len(hit), self.k)
        self.floor = self.lows.min(axis=1)
        old, now = self.high >= self.floor[self.rows], up >= self.floor[rows]
        ids = ids[cols[now]]
        self.ids = ids if self.ids is None else np.concatenate([self.ids[old], ids])
        self.rows = np.concatenate([self.rows[old], rows[now]])
        self.low = np.concatenate([self.low[old], down[now]])
        self.high = np.concatenate([self.high[old], up[now]])

    @staticmethod
    def _low(high: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The lower bounds that belong to the upper ones, rounded down; none without a number."""
        with np.errstate(invalid="ignore"):
            low = high - 2 * reach
            low = low - (np.abs(high) + 2 * reach) * np.float32(2.0 ** -22)
        return np.where(np.isinf(high), np.float32(-np.inf), low)

    def emit(self, schema: pa.Schema) -> pa.RecordBatch:
        if self.ids is None:
            return pa.RecordBatch.from_pylist([], schema=schema)
        return pa.RecordBatch.from_arrays(
            [self.keys.combine_chunks().take(pa.array(self.rows)), pa.array(self.ids).cast(schema.field(1).type),
             *(pa.array(np.where(np.isinf(c), c, c * np.where(np.isinf(self.norm), 1, self.norm)[self.rows]).astype(float))
               for c in (self.low, self.high))], schema=schema)


def candidates(queries: DataFrame, index: VectorIndex, k: int, query_id: str, vector: str = "vector",
               exclude_self: bool = True, block: int = QUERIES, index_block: int = ROWS) -> DataFrame:
    """(query_id, hit, low, high): rows that may be among the best k of a query, by bounds alone.

    Up to ``block`` queries are held by every task and the codes are scanned in place. Beyond, blocks of
    queries meet blocks of codes in a cross join that shuffles neither; a task keeps its bounds over all its blocks.
    """
    asked = queries.select(query_id, vector).filter(F.col(vector).isNotNull())
    codes = index.table("codes")
    out = T.StructType([asked.schema[query_id], T.StructField("hit", codes.schema["id"].dataType),
                        T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    arrow = to_arrow_schema(out)
    rows, values = bt.size_of(asked, F.size(vector))
    if rows <= block and values <= bt.VALUES:
        shared = queries.sparkSession.sparkContext.broadcast(asked.toArrow())

        def scan(batches):
            found = _Bounds(shared.value, k, exclude_self) if shared.value.num_rows else None
            for batch in batches:
                if found is not None and batch.num_rows:
                    found.add(batch)
            if found is not None:
                yield found.emit(arrow)

        found = codes.mapInArrow(scan, out)
    else:
        n_q = max(-(-rows // block), -(-values // bt.VALUES))
        found = bt.every_pair(
            bt.in_blocks(asked, -(-rows // n_q), rows, "asked", together=True),
            bt.in_blocks(codes, index_block, codes.count(), "codes"),
            lambda part: _Bounds(part, k, exclude_self), lambda own, part: own.add(part), lambda own: own.emit(arrow), out)
    # what is left by the k-th lower bound over all tasks
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("low")))
    found = materialise(found, "candidates")
    floors = (found.withColumn("place", place).filter(F.col("place") <= k).groupBy(query_id)
              .agg(F.when(F.count("*") == k, F.min("low")).alias("floor")))
    return (found.join(floors, query_id).filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
            .select(query_id, "hit", "low", "high"))


def id_ranges(ids: DataFrame, column: str, ranges: int = RANGES) -> Column | None:
    """A condition on ``id`` that holds for all of ``column``: at most ``ranges`` ranges around them.

    The ids are cut into as many even parts; only their bounds come to the driver.
    """
    parts = (ids.select(column).distinct().repartitionByRange(ranges, column)
             .groupBy(F.spark_partition_id().alias("part")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
             .collect())
    tests = [F.col("id").between(r["lo"], r["hi"]) for r in parts]
    return reduce(lambda a, b: a | b, tests) if tests else None


def nearest_quantised(queries: DataFrame, index: VectorIndex, k: int = 4, query_id: str = "id",
                      vector: str = "vector", exclude_self: bool = True, block: int = QUERIES,
                      index_block: int = ROWS) -> DataFrame:
    """(query_id, neighbour_id, similarity, rank), the exact best k by product, then id.

    ``query_id`` is unique; a query's own row is left out by its id. Null query vectors find nothing.
    """
    close = materialise(candidates(queries, index, k, query_id, vector, exclude_self, block, index_block), "close")
    exact = index.table("exact")
    wanted = id_ranges(close, "hit")
    asked = queries.select(F.col(query_id), F.col(vector).cast("array<double>").alias("_q"))
    theirs = (exact if wanted is None else exact.filter(wanted)).select(
        F.col("id").alias("hit"), F.col("vector").cast("array<double>").alias("_x"))
    scored = (close.select(query_id, "hit").join(theirs, "hit").join(asked, query_id)
              .select(query_id, F.col("hit").alias("neighbour_id"), vx.dot(F.col("_q"), F.col("_x")).alias("similarity")))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("similarity"), F.asc("neighbour_id")))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
