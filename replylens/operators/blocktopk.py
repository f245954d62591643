"""Best k per query over a large table, without ever emitting all pairs.

A block of queries meets one partition (or block) of the index at a time. Scores live in
a small array inside the task and only the running best k per query leave it, so the
shuffle carries queries x k x tasks rows instead of queries x rows.

A query side of at most ``BLOCK`` rows and ``VALUES`` numbers or terms (counted, not
assumed) is broadcast and the index is read in place. Beyond that both sides are packed into bounded blocks,
each stored once, and every block of queries meets every block of the index in a cross join, which
shuffles neither. A task keeps the best k of its queries over all blocks it reads. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from replylens.session import materialise

BLOCK = 4096
INDEX_BLOCK = 65_536
INDEX_VALUES = 1_000_000    # numbers or terms of a block of the index, unless one row has more
VALUES = 16_000_000
CELLS = 4_000_000
HELD = 4_000_000            # numbers of query blocks that a task has at hand, unless one block has more


class RunningBest:
    """Best k (score descending, id ascending) per query, merged batch by batch."""

    def __init__(self, k: int, n_queries: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self.rows = np.empty(0, dtype=np.int64)
        self.scores = np.empty(0)
        self.ids = None

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.ids is not None:
            rows = np.concatenate([self.rows, rows])
            scores = np.concatenate([self.scores, scores])
            ids = np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        first = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - first < self.k
        self.rows, self.scores, self.ids = rows[keep], scores[keep], ids[keep]
        full = np.bincount(self.rows, minlength=len(self.floor)) >= self.k
        last = np.searchsorted(self.rows, np.arange(len(self.floor)), side="right") - 1
        self.floor[full] = self.scores[last[full]]


# score(block, batch, best): fold one index batch into the running best.
Scorer = Callable[[pa.Table, pa.RecordBatch | pa.Table, RunningBest], None]


def as_numpy(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=str)
    return column.to_numpy(zero_copy_only=False)


def _emit(block: pa.Table, best: RunningBest, schema: pa.Schema) -> pa.RecordBatch:
    if best.ids is None:
        return pa.RecordBatch.from_pylist([], schema=schema)
    return pa.RecordBatch.from_arrays([
        block.column(0).combine_chunks().take(pa.array(best.rows)),
        pa.array(best.ids).cast(schema.field(1).type),
        pa.array(best.scores, type=pa.float64())], schema=schema)


def size_of(queries: DataFrame, values: Column) -> tuple[int, int]:
    """Rows of the query side and how many values they hold altogether."""
    row = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(values.cast("long")).alias("v")).first()
    return row["n"], row["v"] or 0


def _output(queries: DataFrame, index: DataFrame, query_id: str, index_id: str) -> T.StructType:
    return T.StructType([T.StructField(query_id, queries.schema[0].dataType),
                         T.StructField(index_id, index.schema[0].dataType),
                         T.StructField("score", T.DoubleType())])


def _runner(k: int, prepare: Callable[[pa.Table], object], score: Scorer, schema: pa.Schema):
    def run(block: pa.Table, batches) -> pa.RecordBatch:
        best = RunningBest(k, block.num_rows)
        ready = prepare(block) if block.num_rows else None
        for batch in batches:
            if ready is not None and batch.num_rows:
                score(ready, batch, best)
        return _emit(block, best, schema)
    return run


def in_blocks(df: DataFrame, size: int, rows: int, name: str, by: Sequence[str] = (),
              together: bool = False) -> DataFrame:
    """``df``, of ``rows`` rows, stored as (block, rows): up to ``size`` rows packed as one value.

    Rows are dealt by their first column or by ``by``; then no block has rows of two keys. With ``together``
    rows of one id share a block, which may be larger for it.
    """
    arrow = to_arrow_schema(df.schema)
    spark = df.sparkSession
    parts = min(-(-rows // size), int(spark.conf.get("spark.sql.shuffle.partitions"))) or 1
    keys = [arrow.get_field_index(c) for c in by]

    def pack(batches):
        from pyspark import TaskContext
        block, held, n, last, own = TaskContext.get().partitionId() << 32, [], 0, None, None

        def packed():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, arrow) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                              names=["block", "rows"])

        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, schema=arrow)
            values = list(zip(*(batch.column(c).to_pylist() for c in keys))) or [()] * batch.num_rows
            ids = batch.column(0).to_pylist() if together else []
            cuts = [i for i in range(1, len(values)) if values[i] != values[i - 1]]
            for lo, hi in zip([0, *cuts], [*cuts, len(values)]):
                while lo < hi:
                    if held and (values[lo] != last or n >= size and not (together and ids[lo] == own)):
                        yield packed()
                        block, held, n = block + 1, [], 0
                    end = min(hi, lo + max(1, size - n))
                    while together and end < hi and ids[end] == ids[end - 1]:
                        end += 1
                    held.append(batch.slice(lo, end - lo))
                    n, last, own = n + end - lo, values[lo], ids[end - 1] if together else None
                    lo = end
        if held:
            yield packed()

    dealt = df.repartition(parts, *(by or df.columns[:1]))
    if by or together:
        dealt = dealt.sortWithinPartitions(*(by or df.columns[:1]))
    return materialise(dealt.mapInArrow(pack, "block long, rows binary"), name)


def every_pair(left: DataFrame, right: DataFrame, fresh: Callable[[pa.Table], object],
               add: Callable[[object, pa.Table], None], emit: Callable[[object], pa.RecordBatch],
               out: T.StructType) -> DataFrame:
    """Every block of ``left`` with every block of ``right``; neither is shuffled.

    ``fresh`` makes what a task holds of a left block, ``add`` folds a right block into it and ``emit``
    gives its rows. Blocks of one task that meet its right blocks in turn are held side by side, up
    to ``HELD`` numbers.
    """
    pairs = left.select(F.col("block").alias("own"), F.col("rows").alias("asked")).crossJoin(
        right.select(F.col("block").alias("other"), F.col("rows").alias("known")))

    def table(value) -> pa.Table:
        return pa.ipc.open_stream(value.as_buffer()).read_all()

    def run(batches):
        held, size = {}, 0
        at, known = None, None
        for batch in batches:
            for i, (own, other) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if own not in held:
                    rows = table(batch.column(1)[i])
                    values = rows.nbytes // 4
                    if held and size + values > HELD:
                        yield from map(emit, held.values())
                        held, size = {}, 0
                    held[own], size = fresh(rows), size + values
                if other != at or known is None:
                    at, known = other, table(batch.column(3)[i])
                add(held[own], known)
            at, known = None, None      # it lies in the batch
        yield from map(emit, held.values())

    return pairs.mapInArrow(run, out)


class _Asked:
    """A block of queries in a task: what ``prepare`` made of it, and the best so far."""

    def __init__(self, block: pa.Table, k: int, prepare: Callable[[pa.Table], object]):
        self.keys, self.ready, self.best = block.select([0]), prepare(block), RunningBest(k, block.num_rows)


def best_k_of_pairs(left: DataFrame, right: DataFrame, k: int, prepare: Callable[[pa.Table], object],
                    score: Scorer, out: T.StructType) -> DataFrame:
    """``out``: the best k per query and task, over blocks made by ``in_blocks``."""
    schema = to_arrow_schema(out)
    return every_pair(left, right, lambda block: _Asked(block, k, prepare),
                      lambda own, known: score(own.ready, known, own.best),
                      lambda own: _emit(own.keys, own.best, schema), out)


def best_k(queries: DataFrame, index: DataFrame, k: int, prepare: Callable[[pa.Table], object],
           score: Scorer, query_id: str, index_id: str, size: tuple[int, int],
           block: int = BLOCK, index_block: int = INDEX_BLOCK) -> DataFrame:
    """(query_id, index_id, score, rank) for the best k index rows of each query.

    The first column of each frame is its id, unique within the frame. ``size`` is the
    ``size_of`` the queries. ``prepare`` turns a block of queries into whatever ``score``
    wants, once per task.
    """
    rows, values = size
    if rows <= block and values <= VALUES:
        out = _output(queries, index, query_id, index_id)
        run = _runner(k, prepare, score, to_arrow_schema(out))
        shared = queries.sparkSession.sparkContext.broadcast(queries.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield run(shared.value, batches)

        found = index.mapInArrow(scan, out)
    else:
        n_q = max(-(-rows // block), -(-values // VALUES))
        left = in_blocks(queries, -(-rows // n_q), rows, "asked", together=True)
        known = max(1, min(index_block, INDEX_VALUES // max(1, -(-values // rows))))
        right = in_blocks(index, known, index.count(), "known")
        found = best_k_of_pairs(left, right, k, prepare, score, _output(queries, index, query_id, index_id))
    rank = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(index_id))
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
