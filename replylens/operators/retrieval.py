"""Finding past cases: exact vector search, ordered lookup, optional approximate search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replylens.functions import vectors as vx
from replylens.operators import blocktopk as bt
from replylens.session import materialise

TOP_K = 4
_TIE = 1e-9
# Bounds of the samples the approximate index is fitted and measured on.
ROWS_PER_CELL, SAMPLE = 64, 256
# Queries whose scores are copied, and numbers that are multiplied again, at a time.
PARTED, RESCORED = 512, 2_000_000


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _prepare(exclude_self: bool):
    def ready(block: pa.Table):
        ids = bt.as_numpy(block.column(0))
        order = np.argsort(ids, kind="stable") if exclude_self else None
        return ids, order, _matrix(block.column(1))
    return ready


def _score(ready, batch, best: bt.RunningBest, among: np.ndarray | None = None) -> None:
    """One matrix product per slice, then exact rescoring of whatever may be in the best k.

    The product can differ in the last bit between equal vectors, so everything within a
    hair of the k-th score is summed again in a fixed order before ties go to the id. ``among`` are the
    places of the queries that ask, if not all do.
    """
    q_ids, order, whole = ready
    q = whole if among is None else whole[among]
    place = np.arange(len(whole)) if among is None else np.full(len(whole), -1)
    if among is not None:
        place[among] = np.arange(len(among))
    all_ids, vectors = bt.as_numpy(batch.column(0)), batch.column(1)
    step = max(1, bt.CELLS // len(q))
    for start in range(0, len(all_ids), step):
        ids, d = all_ids[start:start + step], _matrix(vectors.slice(start, step))
        approx = q @ d.T
        if order is not None:
            at = np.minimum(np.searchsorted(q_ids, ids, sorter=order), len(q_ids) - 1)
            own = place[order[at]]
            same = np.flatnonzero((q_ids[order[at]] == ids) & (own >= 0))
            approx[own[same], same] = -np.inf
        floor = best.floor.copy() if among is None else best.floor[among]
        new = np.flatnonzero(np.isneginf(floor))
        if len(d) >= best.k and len(new):
            for part in np.array_split(new, -(-len(new) // PARTED)):
                floor[part] = np.partition(approx[part], len(d) - best.k, axis=1)[:, -best.k]
        floor = np.maximum(floor - _TIE, np.finfo(float).min)
        rows, cols = np.nonzero(approx >= floor[:, None])
        most = max(1, RESCORED // d.shape[1]) if d.shape[1] else len(rows) or 1
        for at in range(0, len(rows), most):
            r, c = rows[at:at + most], cols[at:at + most]
            best.add(r if among is None else among[r], (q[r] * d[c]).sum(axis=1), ids[c])


def nearest(queries: DataFrame, index: DataFrame, k: int = TOP_K, query_id: str = "id",
            index_id: str = "tweet_id", vector: str = "vector", exclude_self: bool = True,
            block: int = bt.BLOCK, index_block: int = bt.INDEX_BLOCK) -> DataFrame:
    """Exact top-k cosine of unit vectors, without the query's own row."""
    q = queries.select(F.col(query_id), F.col(vector)).filter(F.col(vector).isNotNull())
    d = index.select(F.col(index_id), F.col(vector)).filter(F.col(vector).isNotNull())
    return (bt.best_k(q, d.withColumnRenamed(index_id, "_hit"), k, _prepare(exclude_self),
                      _score, query_id, "_hit", bt.size_of(q, F.size(vector)), block,
                      index_block)
            .select(query_id, F.col("_hit").alias("neighbour_id"),
                    F.col("score").alias("similarity"), "rank"))


def _fit_centres(index: DataFrame, row_id: str, vector: str, rows: int, cells: int,
                 seed: int) -> np.ndarray:
    """Cell centres by k-means on about ``ROWS_PER_CELL`` rows a cell, drawn by a hash of the id."""
    share = min(1.0, cells * ROWS_PER_CELL / rows)
    sample = index.filter(F.pmod(F.xxhash64(row_id), F.lit(1 << 30)) < share * (1 << 30))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(
        (index if share == 1.0 else sample).select(array_to_vector(vector).alias("features")))
    return np.array(model.clusterCenters())


def _closeness(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return m @ centres.T - (centres * centres).sum(axis=1) / 2


def _near_cells(df: DataFrame, vector: str, centres: np.ndarray, probes: int) -> DataFrame:
    """Each row once per cell among its ``probes`` nearest, in a column ``cell``."""
    shared = df.sparkSession.sparkContext.broadcast(centres)
    at_vector = df.columns.index(vector)

    def assign(batches):
        c = shared.value
        step = max(1, bt.CELLS // len(c))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                far = -_closeness(_matrix(part.column(at_vector)), c)
                near = np.argpartition(far, probes - 1, axis=1)[:, :probes].astype(np.int32)
                ends = np.arange(0, near.size + 1, probes, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))],
                    names=[*part.schema.names, "_cells"])

    schema = T.StructType([*df.schema.fields,
                           T.StructField("_cells", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(assign, schema).select(*df.columns, F.explode("_cells").alias("cell"))


def _probes_for(queries: DataFrame, index: DataFrame, k: int, query_id: str, vector: str,
                centres: np.ndarray, recall: float) -> int:
    """Cells to look into so that ``recall`` of the true neighbours of a query sample are there."""
    asked = queries.orderBy(F.xxhash64(query_id, F.lit("probes")), query_id).limit(SAMPLE)
    hits = nearest(asked, index, k, query_id, "_hit", vector)
    pairs = (index.select(F.col("_hit").alias("neighbour_id"), F.col(vector).alias("_theirs"))
             .join(F.broadcast(hits), "neighbour_id").join(asked, query_id)
             .select(F.col(vector), "_theirs").toArrow())
    if not pairs.num_rows:
        return 1
    mine = _closeness(_matrix(pairs.column(0)), centres)
    cell = _closeness(_matrix(pairs.column(1)), centres).argmax(axis=1)
    place = (mine > np.take_along_axis(mine, cell[:, None], axis=1)).sum(axis=1) + 1
    return int(np.quantile(place, recall, method="higher"))


def nearest_approx(queries: DataFrame, index: DataFrame, k: int = TOP_K, query_id: str = "id",
                   index_id: str = "tweet_id", vector: str = "vector", cells: int | None = None,
                   recall: float = 0.95, seed: int = 7, block: int = bt.BLOCK,
                   index_block: int = bt.INDEX_BLOCK) -> DataFrame:
    """J8, approximate: only index rows in the cells nearest to a query are scored.

    ``cells`` is the square root of the number of index rows unless given. How many of them a
    query looks into is measured: ``SAMPLE`` queries are searched exactly, and as many cells
    are taken as held the share ``recall`` of what they found. Vectors without any structure
    need most cells. A cell may hold most of the data, so it is cut into blocks. Every block of queries meets
    every block of the index, and of it the queries score that look into its cell; neither is shuffled, and
    a task returns the best k of its queries. A query whose cells hold
    fewer than k other rows is searched exactly. Null vectors are neither searched nor found.
    """
    asked = queries.select(F.col(query_id), F.col(vector)).filter(F.col(vector).isNotNull())
    known = index.select(F.col(index_id).alias("_hit"), F.col(vector)).filter(
        F.col(vector).isNotNull())
    rows = known.count()
    if rows == 0:
        return nearest(asked, known, k, query_id, "_hit", vector)
    centres = _fit_centres(known, "_hit", vector, rows, cells or max(2, round(rows ** 0.5)), seed)
    probes = _probes_for(asked, known, k, query_id, vector, centres, recall)
    q_rows, values = bt.size_of(asked, F.size(vector))
    left = bt.in_blocks(asked, -(-q_rows // (max(-(-q_rows // block), -(-values // bt.VALUES)) or 1)) or 1, q_rows, "asked",
                        together=True)
    right = bt.in_blocks(_near_cells(known, vector, centres, 1), index_block, rows, "known", by=["cell"])
    shared = asked.sparkSession.sparkContext.broadcast(centres)
    prepare = _prepare(True)

    def ready(part: pa.Table):
        own = prepare(part)
        far = -_closeness(own[2], shared.value)
        near = np.zeros(far.shape, bool)
        np.put_along_axis(near, np.argpartition(far, probes - 1, axis=1)[:, :probes], True, axis=1)
        return own, near

    def score(own, part: pa.Table, best: bt.RunningBest) -> None:
        among = np.flatnonzero(own[1][:, part.column("cell")[0].as_py()])
        if len(among):
            _score(own[0], part, best, among)

    found = bt.best_k_of_pairs(left, right, k, ready, score, T.StructType([
        asked.schema[query_id], known.schema["_hit"], T.StructField("score", T.DoubleType())]))
    # An index row has one cell, so a pair is found once.
    rank = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc("_hit"))
    best = materialise(
        found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
        .select(query_id, F.col("_hit").alias("neighbour_id"),
                F.col("score").alias("similarity"), "rank"), "approximate")
    full = best.filter(F.col("rank") == k).select(query_id)
    short = asked.join(full, query_id, "left_anti")
    return (best.join(full, query_id, "left_semi")
            .unionByName(nearest(short, known, k, query_id, "_hit", vector)))


def ids_of(hits: DataFrame, query_id: str = "id") -> DataFrame:
    """Hits as one row per query: neighbour ids in rank order and the best similarity."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "neighbour_id")))
    return hits.groupBy(query_id).agg(
        F.transform(ranked, lambda h: h["neighbour_id"]).alias("retrieved_ids"),
        F.max("similarity").alias("top_similarity"))


def evidence_by_ids(cases: DataFrame, index: DataFrame, case_id: str = "id",
                    ids: str = "retrieved_ids", index_id: str = "tweet_id",
                    fields: Sequence[str] = ("customer_text", "brand_reply")) -> DataFrame:
    """Rebuild evidence from stored ids, in their order; unknown ids drop out.

    A case whose ids are all unknown keeps an empty array. A much-cited index row makes a
    hot join key; the index side is unique, so the adaptive skew split applies.
    """
    wanted = cases.select(case_id, F.posexplode(ids).alias("pos", index_id))
    found = wanted.join(index.select(index_id, *fields), index_id)
    item = F.struct("pos", F.col(index_id).alias("tweet_id"), *fields,
                    F.lit(None).cast("double").alias("similarity"))
    built = found.groupBy(case_id).agg(F.sort_array(F.collect_list(item)).alias("evidence"))
    return (cases.join(built, case_id, "left")
            .withColumn("evidence", F.coalesce("evidence", F.array().cast(
                built.schema["evidence"].dataType))))


def leave_one_out_label(vectors: DataFrame, row_id: str = "id", label: str = "label",
                        vector: str = "vector", hits: DataFrame | None = None) -> DataFrame:
    """The label of each row's nearest other row, as (id, gold, pred, top_similarity).

    ``hits`` is the result of ``nearest`` if it is at hand.
    """
    if hits is None:
        hits = nearest(vectors, vectors, 1, row_id, row_id, vector)
    hits = hits.filter("rank = 1")
    gold = vectors.select(F.col(row_id), F.col(label).alias("gold"))
    near = vectors.select(F.col(row_id).alias("neighbour_id"), F.col(label).alias("pred"))
    return (hits.join(near, "neighbour_id").join(gold, row_id)
            .select(row_id, "gold", "pred", F.col("similarity").alias("top_similarity")))


def unit_checked(index: DataFrame, vector: str = "vector", tolerance: float = 1e-5) -> DataFrame:
    """IO8: an index whose every vector has unit length; anything else stops the job."""
    ok = vx.is_unit(F.col(vector), tolerance)
    return index.filter(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(
        F.raise_error(F.lit("index vector is not of unit length")).cast("boolean")))


def cosine(a: Column, b: Column) -> Column:
    return vx.dot(a, b)
