"""Embedding near-duplicates: iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned on a bounded sample so that signs become
balanced binary codes. Codes are cut into substrings, one table each: vectors that agree
in a substring meet in a bucket of that table; how many tables that takes is measured on
sampled vectors moved to the threshold. Of the pairs of a bucket, those whose whole codes are
further apart than such vectors' codes are discarded. The others are reranked with the
original vectors in double precision, so no pair below the threshold is linked.

Equal vectors are one class and are never paired. A bucket larger than a block is cut into
blocks that meet pairwise in tasks of their own. A pair is counted only in the first table
in which its codes agree, so no pair leaves a task: tasks return a link count per vector
and a spanning set of links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import checkpoint, components, stored

SAMPLE = 8192           # rows the rotation is learned from, at most
PROBES = 2048           # rows the tables are planned on, at most
RECALL = 0.98           # share of pairs at the threshold that meet in some table
MODELS = 16             # rotations that codes are taken from, at most
LEAST_BITS = 4          # of a substring
NEAR = 0.999            # share of pairs at the threshold that the distance of whole codes keeps
BLOCK = 1024


def learn_rotation(sample: np.ndarray, bits: int, seed: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): signs of ``(x - mean) @ projection`` are the code bits.

    Principal axes first, then rounds of: codes = signs of the rotated data; rotation =
    the orthogonal map closest to sending the data to its codes.
    """
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    data = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1],) * 2))
    for _ in range(rounds):
        codes = np.where(data @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ data)
        rotation = (left @ right).T
    return mean, axes @ rotation


def moved_pairs(probes: np.ndarray, cosine: float, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors and the same moved to the threshold cosine, once in any direction and
    once towards another probe, which keeps what all vectors have in common."""
    rng = np.random.default_rng(seed)
    noise = rng.standard_normal(probes.shape)
    sine = math.sqrt(max(0.0, 1 - cosine * cosine))

    def across(way):
        way = way - (way * probes).sum(axis=1, keepdims=True) * probes
        return way, np.linalg.norm(way, axis=1, keepdims=True)

    free, size = across(noise)
    free = free / np.maximum(size, 1e-300)
    held, size = across(np.roll(probes, 1, axis=0))
    held = np.where(size > 1e-6, held / np.maximum(size, 1e-300), free)     # probes may lie on one line
    return [(probes, cosine * probes + sine * way) for way in (free, held)]


def plan_tables(rows: int, sample: np.ndarray, probes: np.ndarray, cosine: float, recall: float = RECALL):
    """(bits per substring, number of tables, models) for so many rows.

    Signs are taken after the mean is subtracted, so how often a substring agrees for a
    pair at the threshold depends on what the vectors have in common. It is measured: for
    every width of substrings, tables are taken until the wanted share of probes agrees in
    some table with its moved copy, for either way of moving. Of the widths, the one with the least
    estimated work is taken, whatever the number of rows. Only where vectors resemble each other so
    much that no ``MODELS`` rotations bring the recall, substrings without bits are left: one
    table with a single bucket, which misses nothing.
    """
    dim = sample.shape[1]
    width = min(dim, 64)
    widest = min(dim, max(6, math.ceil(math.log2(max(rows, 2))) - 5), 30)
    pairs = moved_pairs(probes, cosine)
    models: list = []
    agree: list[list[np.ndarray]] = []      # per model and kind of pair: probes x bits
    crowd: list[np.ndarray] = []
    best = (math.inf, 0, 1)
    for bits in range(min(LEAST_BITS, width), widest + 1):
        met = [np.zeros(len(probes), bool) for _ in pairs]
        tables, shared = 0, []
        for m in range(MODELS):
            if m == len(models):
                mean, projection = learn_rotation(sample, width, m)
                models.append((mean, projection))
                signs = [(v - mean) @ projection >= 0 for v in (probes, *(moved for _, moved in pairs))]
                agree.append([signs[0] == other for other in signs[1:]])
                crowd.append(signs[0])
            for at in range(0, width - bits + 1, bits):
                for kind, same in enumerate(agree[m]):
                    met[kind] |= same[:, at:at + bits].all(axis=1)
                codes = crowd[m][:, at:at + bits] @ (1 << np.arange(bits, dtype=np.int64))
                sizes = np.unique(codes, return_counts=True)[1].astype(float)
                shared.append((sizes * (sizes - 1)).sum() / max(1, len(codes) * (len(codes) - 1)))
                tables += 1
                if min(x.mean() for x in met) >= recall:
                    break
            else:
                continue
            break
        else:
            break       # wider substrings agree less often still
        best = min(best, (_work(rows, tables, float(np.mean(shared))), bits, tables))
    _, bits, tables = best
    return bits, tables, models[:-(-tables // (width // bits)) if bits else 0]


def _work(rows: int, tables: int, shared: float) -> float:
    """Estimated work of a row, in compared pairs: a row sent to a block costs about 500
    of them, and carries a code of every table. ``shared`` is the share of the rows in its bucket."""
    bucket = rows * shared
    return tables * ((500 + 5 * tables) * (1 + bucket / BLOCK) + bucket)


def substrings(vectors: np.ndarray, models: list[tuple[np.ndarray, np.ndarray]], bits: int,
               tables: int) -> np.ndarray:
    """The code of every table (rows x tables): consecutive substrings of the codes."""
    out = np.zeros((len(vectors), tables), np.int64)    # without bits: one bucket
    weights = 1 << np.arange(bits, dtype=np.int64)
    t = 0
    for mean, projection in models:
        signs = (vectors - mean) @ projection >= 0
        for at in range(0, signs.shape[1] - bits + 1, bits):
            if t < tables:
                out[:, t] = signs[:, at:at + bits] @ weights
                t += 1
    return out


def whole_codes(vectors: np.ndarray, models: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The code of the first rotation, up to 64 bits, as one number; zero without a rotation."""
    if not models:
        return np.zeros(len(vectors), np.uint64)
    mean, projection = models[0]
    signs = (vectors - mean) @ projection >= 0
    return np.bitwise_or.reduce(signs.astype(np.uint64) << np.arange(signs.shape[1], dtype=np.uint64), axis=1)


def code_radius(probes: np.ndarray, models: list[tuple[np.ndarray, np.ndarray]], cosine: float,
                near: float = NEAR) -> int:
    """Distance of whole codes within which the share ``near`` of pairs at the threshold lies.

    Measured on probes and their moved copies, for the way of moving that parts codes more.
    """
    apart = [np.bitwise_count(whole_codes(a, models) ^ whole_codes(b, models)) for a, b in moved_pairs(probes, cosine, 1)]
    return max(int(np.quantile(d, near, method="higher")) for d in apart)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column padded with zeros to the same length."""
    sizes = np.asarray(pc.list_value_length(column), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _unit(matrix: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that no square leaves the double range
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True, initial=1e-300)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _labels(adjacent: np.ndarray) -> np.ndarray:
    """Smallest row reachable over a symmetric adjacency matrix."""
    n = len(adjacent)
    label = np.arange(n, dtype=np.int32)
    while True:
        near = np.where(adjacent, label, np.int32(n)).min(axis=1, initial=n)
        after = np.minimum(label, near)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _block_links(node: np.ndarray, side: np.ndarray, vectors: np.ndarray, codes: np.ndarray, whole: np.ndarray,
                 weight: np.ndarray, table: int, cosine: float, radius: int):
    """Links of one bucket, or of two blocks of one.

    ``side`` is 0 and 1 for two blocks, whose own pairs belong to other tasks. Pairs whose ``whole``
    codes differ in more than ``radius`` bits are not looked at. Returns link counts of rows
    and (row, smallest row linked in this task).
    """
    near = np.bitwise_count(whole[:, None] ^ whole[None, :]) <= radius
    if side.any():
        near &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(near, 1))
    close = np.zeros((len(node), len(node)), bool)
    for at in range(0, len(a), 1 << 16):
        i, j = a[at:at + (1 << 16)], b[at:at + (1 << 16)]
        close[i, j] = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= cosine
    close |= close.T
    if not close.any():
        return None
    first = close.copy()
    rows = np.flatnonzero(close.any(axis=1))
    for t in range(table):                          # met in an earlier table: counted there
        first[np.ix_(rows, rows)] &= codes[rows, t][:, None] != codes[rows, t][None, :]
    counts = first @ weight
    return counts, _labels(close)


def link_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id",
                 vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    ``n_links`` counts other vectors of at least that cosine, ``component_id`` is the
    smallest id reachable. Null, empty and zero vectors and those with null or non-finite
    components link with nothing and are their own component. Shorter vectors are padded
    with zeros. Rows equal in id and vector are one row of the result. A null id takes
    part but names no component unless it is alone.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("v"))
    kind = rows.schema["v"].dataType
    usable = (F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
              & F.exists("v", lambda x: x != 0))
    usable = F.coalesce(usable, F.lit(False))
    # -0.0 and 0.0 are one value; the key of a class is its smallest row
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0)).cast(kind))).distinct()
    rows = stored(rows.withColumn("digest", F.sha2(F.to_json("v"), 256)), "vectors")
    valid = rows.filter("v is not null")
    classes = stored(valid.groupBy("digest").agg(F.first("v").alias("v"), F.count("*").alias("weight"),
                                                 F.min("vec_id").alias("least"))
                     .withColumn("node", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    linked = _class_links(spark, classes, total, cosine, sample) if total > 1 else None
    own = rows.join(classes.select("digest", "node", "weight", "least"), "digest", "left")
    alone = F.when(F.col("weight").isNull(), F.lit(0)).otherwise(F.col("weight") - 1)
    if linked is None:
        found = own.select("vec_id", alone.alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    else:
        counts, roots = linked
        found = (own.join(counts, "node", "left").join(roots, "node", "left")
                 .select("vec_id", (alone + F.coalesce("links", F.lit(0))).alias("n_links"),
                         F.coalesce("root_id", "least", "vec_id").alias("component_id")))
    return found.select("vec_id", F.col("n_links").cast("long"), "component_id",
                        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _type(classes: DataFrame) -> str:
    return classes.schema["v"].dataType.simpleString()


def _class_links(spark, classes: DataFrame, total: int, cosine: float, sample: int):
    """(node, links) and (node, root_id) of classes that link with another class."""
    # rows behind the sample are new to the rotations; a smaller table is planned on its own rows
    picked = classes.orderBy(F.xxhash64("digest")).limit(sample + PROBES).select("v").toArrow()
    data = _matrix(picked.column("v").combine_chunks())
    dim = max(data.shape[1], classes.agg(F.max(F.size("v"))).first()[0])
    data = _unit(np.pad(data, ((0, 0), (0, dim - data.shape[1]))))
    bits, tables, models = plan_tables(total, data[:sample], data[-PROBES:], cosine)
    radius = code_radius(data[-PROBES:], models, cosine)
    models = spark.sparkContext.broadcast(models)       # dim x 64 numbers each

    def encode(batches):
        for batch in batches:
            matrix = _matrix(batch.column("v"))
            matrix = _unit(np.pad(matrix, ((0, 0), (0, dim - matrix.shape[1]))))
            codes = substrings(matrix, models.value, bits, tables)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "weight", "v")),
                 pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel(), pa.int32()), tables).cast(pa.list_(pa.int32())),
                 pa.array(whole_codes(matrix, models.value).view(np.int64))],
                names=["node", "weight", "v", "codes", "whole"])

    coded = stored(classes.select("node", "weight", "v")
                   .mapInArrow(encode, f"node long, weight long, v {_type(classes)}, codes array<int>, whole long"), "codes")
    keys = coded.select("node", F.posexplode("codes").alias("t", "code"))
    # stored, so that the join shuffles both sides and a hot bucket can be split
    crowded = checkpoint(keys.groupBy("t", "code").agg(F.count("*").alias("n")).filter("n > 1")
                         .select("t", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    met = keys.join(crowded, ["t", "code"])
    # block b of a bucket goes to every pair of blocks it is part of
    b = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = (met.withColumn("b", b)
           .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
           .select("node", "t", "code", F.least("b", "other").alias("b1"), F.greatest("b", "other").alias("b2"),
                   (F.col("b") > F.col("other")).cast("int").alias("side")))
    group = ["t", "code", "b1", "b2"]
    met = met.join(coded, "node").repartition(*group).sortWithinPartitions(*group)
    kept = [*group, "side", "node", "weight", "v", "codes", "whole"]

    def link(batches):
        held = None
        for batch in batches:
            table = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            keys = np.stack([table.column(c).to_numpy() for c in group])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            held = table.slice(int(starts[-1]))
            yield from links(table, starts)
        if held is not None:
            yield from links(held, np.array([0, held.num_rows]))

    def links(table, bounds):
        """Whole groups lie between consecutive bounds."""
        if len(bounds) < 2:
            return
        table = table.slice(0, int(bounds[-1])).combine_chunks()
        vectors = _matrix(table.column("v").chunk(0))
        vectors = _unit(np.pad(vectors, ((0, 0), (0, dim - vectors.shape[1]))))
        codes = table.column("codes").chunk(0).flatten().to_numpy().reshape(-1, tables)
        node, side, weight, t, b1, b2, whole = (table.column(c).to_numpy() for c in (
            "node", "side", "weight", "t", "b1", "b2", "whole"))
        whole = whole.view(np.uint64)       # signed numbers would be counted without their sign
        out = [[], [], []]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo < 2:
                continue
            s = side[lo:hi] if b1[lo] != b2[lo] else np.zeros(hi - lo, np.int64)
            got = _block_links(node[lo:hi], s, vectors[lo:hi], codes[lo:hi], whole[lo:hi], weight[lo:hi], int(t[lo]),
                               cosine, radius)
            if got is not None:
                counts, label = got
                at = np.flatnonzero((counts > 0) | (label != np.arange(hi - lo)))
                out[0].append(node[lo:hi][at])
                out[1].append(counts[at])
                out[2].append(node[lo:hi][label[at]])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out],
                                             names=["node", "links", "root"])

    found = stored(met.select(*kept).mapInArrow(link, "node long, links long, root long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.selectExpr("node a", "root b"))
    least = (parts.join(classes.select("node", "least"), "node").groupBy("root")
             .agg(F.min("least").alias("root_id")))
    return checkpoint(counts), checkpoint(parts.join(least, "root").select("node", "root_id"))
