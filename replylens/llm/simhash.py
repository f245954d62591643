"""SimHash near-dedup with pivot distance tables.

Every text gets a 64-bit fingerprint. For each distinct fingerprint the Hamming distances
to a fixed set of reference fingerprints are computed once. By the triangle inequality two
fingerprints are at least as far apart as their distances to any reference differ, so a
pair is discarded when its largest coordinate difference exceeds the radius; survivors are
verified bit by bit.

Which pairs are held against the table: fingerprints within radius r agree in at least
b - r of b blocks of bits, so all pairs within the radius share the values of some b - r
blocks, and only those that do are looked at. Equal fingerprints are one row. A bucket
larger than a block of rows is cut into blocks that meet pairwise in tasks of their own.
Tasks return a spanning set of links, never pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import checkpoint, components, pieces_of, stored
from replylens.llm.lattice import tokens_of

RADIUS = 3
PIVOTS = 32
BLOCK = 1024
SHINGLE = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set where more than half of the shingles' hashes have it; 0 without words."""
    words = tokens_of(text)
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(words) < shingle:
        grams = [" ".join(words)]
    else:
        grams = map(" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.array([hash64(g, 42) for g in grams], dtype=np.uint64)
    sums = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > len(hashes)).tobytes(), "big")


def references(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: hashes of 0 to n - 1."""
    return np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(n)], dtype=np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, bits), the fingerprint as a signed 64-bit number; one row per input row."""
    def run(batches):
        for batch in pieces_of(batches):
            bits = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))],
                                             names=["doc_id", "bits"])

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, bits long")


def pivot_table(bits: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances to every reference (rows x references)."""
    return np.bitwise_count(bits.view(np.uint64)[:, None] ^ pivots[None, :]).astype(np.int8)


def close_pairs(bits: np.ndarray, side: np.ndarray, table: np.ndarray, radius: int):
    """(i, j), i < j, of all pairs within the radius; between the two sides if there are two."""
    n = len(bits)
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0].astype(np.int64)
    ends = np.searchsorted(first, first + radius, side="right")     # partners by the first pivot
    sizes = ends - np.arange(n) - 1
    left = np.repeat(np.arange(n), sizes)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i, j = order[left], order[right]
    if side.any():
        kept = side[i] != side[j]
        i, j = i[kept], j[kept]
    for p in range(1, table.shape[1]):
        if not len(i):
            break
        kept = np.abs(table[i, p] - table[j, p]) <= radius
        i, j = i[kept], j[kept]
    values = bits.view(np.uint64)
    kept = np.bitwise_count(values[i] ^ values[j]) <= radius
    return i[kept], j[kept]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = label[label]
        if (label == before).all():
            return label


def _blocks_of(radius: int) -> tuple[int, list[tuple[int, int]]]:
    """(agreeing blocks, bounds of all blocks): radius + 2 blocks, of which 2 agree."""
    n = radius + 2
    cuts = [round(k * 64 / n) for k in range(n + 1)]
    return 2, list(zip(cuts[:-1], cuts[1:]))


def link_fingerprints(bits: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(bits, root) of distinct fingerprints that have another within the radius.

    ``root`` is the smallest fingerprint reachable over such steps.
    """
    agree, bounds = _blocks_of(radius)
    keys = []
    for number, chosen in enumerate(combinations(bounds, agree)):
        value = F.lit(number).cast("long")
        for low, high in chosen:
            part = F.shiftrightunsigned("bits", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
            value = F.shiftleft(value, high - low).bitwiseOR(part)
        keys.append(value)
    keyed = bits.select("bits", F.explode(F.array(*keys)).alias("key"))
    # stored, so that the join shuffles both sides and a hot key can be split
    crowded = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
                         .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    met = (keyed.join(crowded, "key")
           .withColumn("b", F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int"))
           .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
           .select("bits", "key", F.least("b", "other").alias("b1"), F.greatest("b", "other").alias("b2"),
                   (F.col("b") > F.col("other")).cast("int").alias("side")))
    group = ["key", "b1", "b2"]
    met = met.repartition(*group).sortWithinPartitions(*group)
    pivots = references()

    def run(batches):
        held = None
        for batch in batches:
            table = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            keys = np.stack([table.column(c).to_numpy() for c in group])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            held = table.slice(int(starts[-1]))
            yield from links(table, starts)
        if held is not None:
            yield from links(held, np.array([0, held.num_rows]))

    def links(table, edges):
        if len(edges) < 2:
            return
        bits, side, b1, b2 = (table.column(c).to_numpy() for c in ("bits", "side", "b1", "b2"))
        distances = pivot_table(bits[:edges[-1]], pivots)
        found: list[np.ndarray] = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo < 2:
                continue
            own = bits[lo:hi]
            two = side[lo:hi] if b1[lo] != b2[lo] else np.zeros(hi - lo, np.int32)
            i, j = close_pairs(own, two, distances[lo:hi], radius)
            if len(i):
                label = spanning(len(own), i, j)
                at = np.flatnonzero(label != np.arange(len(own)))
                found.append(np.stack([own[at], own[label[at]]]))
        if found:
            both = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    edges = met.select(*group, "side", "bits").mapInArrow(run, "a long, b long")
    return components(edges).withColumnsRenamed({"node": "bits"})


def group_documents(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    ``component_id`` is the smallest id reachable over fingerprints within the radius. A
    null id takes part but names a group only if no row of it has an id (then null). Null,
    empty and wordless texts have fingerprint zero and are linked like any other.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = checkpoint(rows.groupBy("bits").agg(F.min("doc_id").alias("least")))
    linked = link_fingerprints(classes.select("bits"), radius)
    rooted = classes.join(linked, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    named = checkpoint(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    names = rooted.select("bits", "root").join(named, "root").select("bits", "component_id")
    return (rows.join(names, "bits")
            .select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"))
