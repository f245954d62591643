"""A text classifier on word 1- and 2-grams, fitted by Newton steps on all labelled texts.

The training rows lie in blocks by gram, packed. With an L2 penalty the best weights are a combination of the
training rows, so the fit works on one number per row and class, and all it asks of the blocks is the product
of the rows' Gram matrix with such numbers. The numbers of the fit lie in blocks by row and stay on the executors: a
pass sends one number per row and class to every set of gram blocks and gets as many back; the driver sees
sums only. Directions come from conjugate gradients on the Hessian, each a pass; steps along them need none.
"""

from __future__ import annotations

import os
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from replylens.operators.joins import only_split
from replylens.session import materialise, scratch_path

WORDS = 200_000             # words that are looked at at a time, unless one text has more
LEAST, MOST = 250_000, 1_500_000    # grams in the texts of a block: at least up to 16 blocks, at most beyond
JUDGED = 6_000_000          # the same where texts are classified
NUMBERS = 1 << 18           # numbers by row and class in a row block
HELD = 2_000_000            # numbers of a model that every task may hold


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """Letters of the European blocks and what is left of each without its marks."""
    pairs = []
    for start, end in ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)):
        for code in range(start, end):
            base = "".join(c for c in unicodedata.normalize("NFKD", chr(code))
                           if not unicodedata.combining(c))
            if len(base) == 1 and base != chr(code) and base not in "'\\ ":
                pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def words_of(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores, without accents."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), *accent_map()), r"\p{Mn}", "")
    return F.regexp_extract_all(F.lower(plain), F.lit(r"(?U)(\b\w\w+\b)"), 1)


def _grams(words: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All words and pairs of neighbours, and the row of each."""
    flat = words.flatten()
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    if len(flat) < 2:
        return flat.cast(pa.string()), row
    beside = pa.array(row[1:] == row[:-1])
    pairs = pc.binary_join_element_wise(flat[:-1], flat[1:], " ").filter(beside)
    return pa.concat_arrays([flat.cast(pa.string()), pairs.cast(pa.string())]), np.r_[row, row[:-1][row[1:] == row[:-1]]]


def _parts(batch: pa.RecordBatch, column: str, most: int):
    """Runs of rows of a batch whose lists of words have ``most`` words together, one row at least."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    reach, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(reach, reach[lo] - sizes[lo] + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


class _Lookup:
    """Places of grams in a list of them, found by numbers: words have codes, and pairs a key of two codes."""

    def __init__(self, grams: pa.Array):
        parts = pc.split_pattern(grams, " ", max_splits=1)
        words = pc.dictionary_encode(parts.flatten())
        self.words, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        last = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)) - 1
        two = np.diff(np.r_[-1, last]) == 2
        keys = code[last]
        keys[two] += (1 + code[last[two] - 1]) * len(self.words)
        order = np.argsort(keys)
        self.keys, self.place = keys[order], order.astype(np.int32)

    def of(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(place, row) of every known word and pair of neighbours."""
        code = pc.fill_null(pc.index_in(words.flatten(), self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        one = np.flatnonzero(code >= 0)
        two = one[:-1][(np.diff(one) == 1) & (row[one[1:]] == row[one[:-1]])]
        keys = np.r_[code[one], (1 + code[two]) * len(self.words) + code[two + 1]]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(0, bool)
        return self.place[at[hit]].astype(np.int64), np.r_[row[one], row[two]][hit]


def _counted(code: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, row, occurrences), sorted by gram, then row."""
    pair, tf = np.unique(code * rows + row, return_counts=True)
    return *np.divmod(pair, max(1, rows)), tf


def _hashed(grams: pa.Array) -> np.ndarray:
    """A hash of every gram that is the same everywhere; its remainder by the number of blocks is the gram's block."""
    return pd.util.hash_array(grams.to_numpy(zero_copy_only=False), categorize=False)


def _bits(hashes: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a gram among 2^power bits."""
    return hashes >> np.uint64(64 - power), (hashes >> np.uint64(9)) & np.uint64((1 << power) - 1)


def _sieve(grams: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of the grams: what is not in it is none of them. It has 32 MB at most."""
    power = min(28, max(16, (8 * size).bit_length()))

    def run(batches):
        marks = np.zeros(1 << power, bool)
        for batch in batches:
            for at in _bits(_hashed(batch.column("gram")), power):
                marks[at] = True
        yield pa.RecordBatch.from_arrays(_packed(np.packbits(marks)), names=["marks"])

    out = np.zeros((1 << power) // 8, np.uint8)
    for r in grams.select("gram").coalesce(8).mapInArrow(run, "marks binary").toLocalIterator():
        out |= np.frombuffer(bytes(r["marks"]), np.uint8)
    return out


def _passes(hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    one, two = (sieve[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1
                for at in _bits(hashes, len(sieve).bit_length() + 2))
    return (one & two).astype(bool)


def _runs(batch: pa.RecordBatch):
    """Runs of rows with numbers that follow each other, 65,536 at most: a batch may hold rows of several files."""
    row = batch.column("row").to_numpy()
    edges = np.r_[0, np.flatnonzero(np.diff(row) != 1) + 1, len(row)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        for at in range(lo, hi, 1 << 16):
            yield batch.slice(at, min(hi - at, 1 << 16))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Stored in little space, and what Spark shuffled for it is let go of at once."""
    conf = df.sparkSession.conf
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {k: conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            conf.set(k, v)
        return materialise(df, name)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _packed(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in arrays]


def _number_blocks(grams: int, most: int) -> int:
    return max(min(16, 1 + grams // LEAST), -(-grams // most))


def _narrow(tf: np.ndarray) -> np.ndarray:
    """Occurrences, a byte each where they fit."""
    return tf.astype(np.uint8 if len(tf) and tf.max() < 256 else np.int32)


def _entries(rows, tf) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(rows, np.uint16)
    return rows, np.frombuffer(tf, np.uint8 if len(tf) == len(rows) else np.int32)


SPREAD = "block int, base long, size int, grams array<string>, df binary, counts binary, rows binary, tf binary"


def _spread(texts: DataFrame, blocks: int, sieve=None) -> DataFrame:
    """The grams of ``texts`` (row, n, words), a row for each block and run of texts.

    It has the run's first row and its size, its distinct grams in that block, for each how often its texts stand and how many
    there are, and for each of these its place in the run and how often the gram is in it. Every run has a row of block 0.
    Grams that do not pass the broadcast ``sieve`` are left out; with it, how often texts stand is, too.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(SPREAD))

    def run(batches):
        for part in (run for batch in batches for part in _parts(batch, "words", WORDS) for run in _runs(part)):
            grams, at = _grams(part.column("words"))
            coded, n = pc.dictionary_encode(grams), part.num_rows
            names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            del grams, coded
            hashes = _hashed(names)
            if sieve is not None:
                known = _passes(hashes, sieve.value)
                stays = known[code]
                code, at, names, hashes = (np.cumsum(known) - 1)[code[stays]], at[stays], names.filter(pa.array(known)), hashes[known]
            code, at, tf = _counted(code, at, n)
            df = np.bincount(code, part.column("n").to_numpy()[at], len(names))
            counts = np.bincount(code, minlength=len(names))
            place = (hashes % np.uint64(blocks)).astype(np.uint16)
            # the entries of a block's grams lie together
            order, entries = np.argsort(place, kind="stable"), np.argsort(place[code], kind="stable")
            ends, last = np.cumsum(np.bincount(place, minlength=blocks)), np.cumsum(np.bincount(place[code], minlength=blocks))
            for block in range(blocks):
                own, e = order[ends[block - 1] if block else 0:ends[block]], entries[last[block - 1] if block else 0:last[block]]
                if len(own) or not block:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int32()), part.column("row").slice(0, 1), pa.array([n], pa.int32()),
                         pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), names.take(pa.array(own))).cast(arrow.field("grams").type),
                         *_packed(df[own] if sieve is None else df[:0], counts[own].astype(np.int32), at[e].astype(np.uint16), _narrow(tf[e]))], schema=arrow)
        pa.default_memory_pool().release_unused()       # the worker waits beside those of the next stage

    return texts.select("row", "n", "words").mapInArrow(run, SPREAD)


def _read(table, column: str, i: int, kind) -> np.ndarray:
    return np.frombuffer(table.column(column)[i].as_buffer(), kind)


GRAMS = "block int, grams array<string>, idf binary, at array<int>, known array<binary>, counts array<binary>, rows array<binary>, tf array<binary>"


def gram_blocks(train: DataFrame, blocks: int, starts: np.ndarray, texts: float, min_df: float) -> DataFrame:
    """Blocks of (grams, idf) over ``train`` (row, n, words), with entries by row block.

    ``starts`` are the first rows of the row blocks, ``texts`` how many texts there are, each as often as it
    stands. idf = ln((1 + texts) / (1 + texts with it)) + 1. A row block has its grams that are in the block, the
    number of rows of each, and for each of these its place in the row block and the gram's occurrences in it.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(GRAMS))

    def build(table):
        table = table.combine_chunks()
        lists = table.column("grams").combine_chunks()
        coded = pc.dictionary_encode(lists.flatten())
        code, grams = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        edges = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
        df = np.zeros(len(grams))
        for i in range(table.num_rows):
            df[code[edges[i]:edges[i + 1]]] += _read(table, "df", i, np.float64)
        kept = df >= min_df
        place = np.cumsum(kept) - 1
        gram, row, tf = [], [], []
        for i in range(table.num_rows):
            own, counts = code[edges[i]:edges[i + 1]], _read(table, "counts", i, np.int32)
            stays = np.repeat(kept[own], counts)
            gram.append(np.repeat(place[own], counts)[stays].astype(np.int32))
            rows, times = _entries(*(table.column(c)[i].as_buffer() for c in ("rows", "tf")))
            row.append(rows[stays].astype(np.int64) + table.column("base")[i].as_py())
            tf.append(times[stays])
        gram, row, tf = np.concatenate(gram), np.concatenate(row), np.concatenate(tf)
        at = np.searchsorted(starts, row, "right") - 1
        row = (row - starts[at]).astype(np.uint16)
        order = np.argsort(((at * len(place) + gram) << 16) + row)
        at, gram, row, tf = at[order], gram[order], row[order], tf[order]
        found, first = np.unique(at, return_index=True)
        chunks = []
        for lo, hi in zip(first, [*first[1:], len(at)]):
            known, counts = np.unique(gram[lo:hi], return_counts=True)
            chunks.append((known.astype(np.int32), counts.astype(np.int32), row[lo:hi],
                           _narrow(tf[lo:hi])))
        idf = np.log((1 + texts) / (1 + df[kept])) + 1
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays(
            [pa.array([table.column("block")[0].as_py()], pa.int32()),
             pa.array([grams.filter(pa.array(kept)).to_pylist()], arrow.field("grams").type), *_packed(idf),
             pa.array([found.tolist()], arrow.field("at").type),
             *(pa.array([[c[k].tobytes() for c in chunks]], pa.list_(pa.binary())) for k in range(4))], schema=arrow)

    return _stored(_spread(train, blocks).groupBy("block").applyInArrow(build, GRAMS), "grams")


class _Block:
    """A gram block as a task holds it."""

    def __init__(self, block: int, idf: bytes, chunks: dict):
        self.block, self.idf, self.chunks = block, np.frombuffer(idf, np.float64), chunks

    def _chunk(self, at: int):
        known, counts, rows, tf = self.chunks[at]
        rows, tf = _entries(rows, tf)
        return np.frombuffer(known, np.int32), np.frombuffer(counts, np.int32), rows.astype(np.intp), 1 + np.log(np.arange(1, int(tf.max()) + 1))[tf - 1]

    def to_grams(self, at: int, numbers: np.ndarray, into: np.ndarray) -> None:
        """Adds the numbers of a row block's rows up by gram."""
        if at in self.chunks:
            known, counts, rows, tf = self._chunk(at)
            starts = np.cumsum(counts) - counts
            for c in range(numbers.shape[1]):
                into[c, known] += np.add.reduceat(numbers[:, c][rows] * tf, starts)

    def to_rows(self, at: int, grams: np.ndarray, rows_of: int, power: int = 1) -> np.ndarray:
        """The numbers of the grams added up by the row block's rows."""
        known, counts, rows, tf = self._chunk(at)
        tf = tf ** power
        return np.stack([np.bincount(rows, np.repeat(g[known], counts) * tf, rows_of) for g in grams], axis=1)


def _held(part):
    """The gram blocks that a task holds, and an iterator over the rest of its rows, which come after them."""
    held = []
    for _, x in part:
        if not isinstance(x, _Block):
            return held, chain([x], (y for _, y in part))
        held.append(x)
    return held, iter(())


def _by_gram(held: list, numbers) -> tuple[list[np.ndarray], dict[int, int]]:
    """Sums by class and gram for every block held, and the sizes of the row blocks."""
    sums, sizes = None, {}
    for at, v in numbers:
        sums = sums or [np.zeros((v.shape[1], len(b.idf))) for b in held]
        sizes[at] = len(v)
        for b, s in zip(held, sums):
            b.to_grams(at, v, s)
    return sums or [], sizes


def _beside(first: RDD, second: RDD) -> RDD:
    """Both, parted by the same keys into as many parts: a part's rows of ``first`` come first, and none is moved."""
    both = first.union(second)
    if both.getNumPartitions() != first.getNumPartitions():
        raise RuntimeError("rows are parted in two ways")
    return both


class _Here:
    """One block of rows, held by this process."""

    def __init__(self, gram, state: dict):
        self.gram, self.state, self.passes = gram, state, 0

    def step(self, moved, vector, settled):
        self.passes += 1
        self.state = moved(self.state)
        v = vector(self.state)
        self.state, sums = settled(self.state, v, self.gram(v))
        return sums

    def total(self, sums):
        return sums(self.state)


class _Apart:
    """Blocks of rows on the executors; one pass over the gram blocks for each step."""

    def __init__(self, blocks: DataFrame, rows: DataFrame, classes: int, sizes: list[int]):
        spark, count = blocks.sparkSession, blocks.count()
        # rows send their numbers to sets of gram blocks, 32 blocks a set where there are many
        sets = self.sets = max(1, min(count, 16), -(-count // 32))
        self.parts = max(1, min(len(sizes), 16), -(-len(sizes) // 4))
        self.classes, self.passes, self.state = classes, 0, None
        local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        self.level = StorageLevel.MEMORY_AND_DISK if local else StorageLevel.MEMORY_AND_DISK_2

        def block(r):
            return r["block"] % sets, _Block(r["block"], bytes(r["idf"]), {
                at: tuple(bytes(r[c][k]) for c in ("known", "counts", "rows", "tf")) for k, at in enumerate(r["at"])})

        self.blocks = blocks.drop("grams").rdd.map(block).partitionBy(sets).persist(StorageLevel.DISK_ONLY)
        sizes = dict(enumerate(sizes))

        def squares(part):
            held, _ = _held(part)
            for at in {at for b in held for at in b.chunks}:
                yield at, sum(b.to_rows(at, [b.idf ** 2], sizes[at], 2)[:, 0] for b in held if at in b.chunks)

        def start(part):
            held, of = {}, {}
            for at, x in part:
                if isinstance(x, dict):
                    held[at] = x
                else:
                    of[at] = of.get(at, 0.0) + x
            for at, s in held.items():
                square = of.get(at, np.zeros(len(s["label"])))
                yield at, _started(s["label"], s["weight"], classes, np.where(square > 0, 1 / np.sqrt(np.maximum(square, 1e-300)), 0.0)[:, None])

        labels = rows.rdd.map(lambda r: (r["at"], {"label": np.frombuffer(bytes(r["label"]), np.int32), "weight": np.frombuffer(bytes(r["weight"]), np.float64)}))
        self._keep(_beside(labels.partitionBy(self.parts), self.blocks.mapPartitions(squares).partitionBy(self.parts))
                   .mapPartitions(start, preservesPartitioning=True))

    def _keep(self, state: RDD) -> list:
        """Holds the state, in two places, and lets go of the one before and of what was sent for it."""
        state = state._reserialize(self.blocks._jrdd_deserializer).persist(self.level)     # as what was sent is, so a task needs one worker
        sums = state.map(lambda x: x[1].get("sums")).collect()
        state._jrdd.rdd().cleanShuffleDependencies(False)
        if self.state is not None:
            self.state.unpersist()
        self.state = state
        return sums

    def _sent(self, numbers) -> RDD:
        """The numbers of the rows beside the gram blocks, for each set of them."""
        sets = self.sets

        def run(part):
            for at, s in part:
                v = s["scale"] * numbers(s)
                for k in range(sets):
                    yield k, (at, v)

        return _beside(self.blocks, self.state.mapPartitions(run).partitionBy(sets))

    def step(self, moved, vector, settled):
        self.passes += 1

        def multiply(part):
            held, numbers = _held(part)
            sums, sizes = _by_gram(held, numbers)
            sums = [s * b.idf ** 2 for b, s in zip(held, sums)]
            for at, size in sizes.items():
                if any(at in b.chunks for b in held):
                    yield at, sum(b.to_rows(at, s, size) for b, s in zip(held, sums) if at in b.chunks)

        def settle(part):
            held, of = {}, {}
            for at, x in part:
                if isinstance(x, dict):
                    held[at] = x
                else:
                    of[at] = of.get(at, 0.0) + x
            for at, s in held.items():
                s = moved(s)
                v = vector(s)
                new, sums = settled(s, v, s["scale"] * of.get(at, np.zeros(v.shape)))
                yield at, {**new, "sums": sums}

        shares = self._sent(lambda s: vector(moved(s))).mapPartitions(multiply).partitionBy(self.parts)
        return sum(self._keep(_beside(self.state, shares).mapPartitions(settle, preservesPartitioning=True)))

    def total(self, sums):
        return sum(self.state.map(lambda x: sums(x[1])).collect())

    def weights(self, numbers) -> RDD:
        """(gram block, weights by gram and class) of a combination of the rows."""
        classes = self.classes

        def run(part):
            held, sent = _held(part)
            sums, _ = _by_gram(held, sent)
            for b, s in zip(held, sums):
                yield b.block, bytearray(np.ascontiguousarray((s * b.idf).T).tobytes())

        return self._sent(numbers).mapPartitions(run)

    def close(self) -> None:
        """Lets go of all that was held and sent."""
        self.state.unpersist()
        self.blocks.unpersist()
        self.blocks._jrdd.rdd().cleanShuffleDependencies(False)


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _started(labels: np.ndarray, weights: np.ndarray, classes: int, scale) -> dict:
    """A block of rows at the start of a fit: numbers a, with their products ga; steps s, rests r and directions d."""
    nothing = np.zeros((len(labels), classes))
    return {"label": labels, "weight": weights, "scale": scale, **{c: nothing for c in ("a", "ga", "s", "gs", "d", "gd")}}


def _fit(rows, classes: int, tol: float = 1e-5, most: int = 30):
    """(what a block's numbers become at the end, intercepts, relative gradient norm, Newton steps)."""
    b, c, t, along = np.zeros(classes), np.zeros(classes), 0.0, 0.0
    first, norm, step = None, np.inf, 0

    def ended(s, t, along):
        """After the last step of a direction, and a step along it."""
        return {**s, "a": s["a"] + along * (s["s"] + t * s["d"]), "ga": s["ga"] + along * (s["gs"] + t * s["gd"])}

    def chances(s, b):
        return _softmax(s["ga"] + b)

    for step in range(most):
        # functions are sent to executors, so they hold numbers as they are now
        def moved(s, t=t, along=along):
            return ended(s, t, along)

        def rest(s, b=b):
            return s["weight"][:, None] * (chances(s, b) - np.eye(classes)[s["label"]])

        def settled(s, v, product):
            # the gradient as numbers per row, their products, and that of the intercepts
            g, gg, nothing = s["a"] + v, s["ga"] + product, np.zeros(v.shape)
            keep = {k: s[k] for k in ("label", "weight", "scale", "a", "ga")}
            return {**keep, "s": nothing, "gs": nothing, "r": -g, "gr": -gg, "d": -g, "gd": -gg, "gg": gg,
                    "h": nothing, "gh": nothing}, np.r_[(g * gg).sum(), v.sum(axis=0)]

        sums = rows.step(moved, rest, settled)
        inner, gb = max(0.0, sums[0]), sums[1:]
        norm = np.sqrt(inner + gb @ gb)
        first = first or max(norm, 1e-300)
        if norm <= tol * first:
            break
        enough = min(0.25, np.sqrt(norm / first)) * norm
        # conjugate gradients for the Newton step; r is what is left of the equation
        c, rb, db, t, turn = np.zeros(classes), -gb, -gb, 0.0, None
        square = inner + rb @ rb
        for _ in range(200):
            def moved(s, t=t, turn=turn):
                if turn is None:
                    return s
                r, gr = s["r"] - t * (s["d"] + s["h"]), s["gr"] - t * (s["gd"] + s["gh"])
                return {**s, "s": s["s"] + t * s["d"], "gs": s["gs"] + t * s["gd"], "r": r, "gr": gr,
                        "d": r + turn * s["d"], "gd": gr + turn * s["gd"]}

            def bent(s, b=b, db=db):
                p, v = chances(s, b), s["gd"] + db
                return s["weight"][:, None] * p * (v - (p * v).sum(axis=1, keepdims=True))

            def settled(s, h, gh):
                q = s["gd"] + gh
                return {**s, "h": h, "gh": gh}, np.r_[(s["d"] * q).sum(), (s["r"] * q).sum(), ((s["d"] + h) * q).sum(), h.sum(axis=0)]

            sums = rows.step(moved, bent, settled)
            curve, t, hb = sums[0] + db @ sums[3:], 0.0, sums[3:]
            if curve <= 0:
                break
            t = square / curve
            c, rb, before = c + t * db, rb - t * hb, square
            inner = max(0.0, inner - 2 * t * sums[1] + t * t * sums[2])
            square = inner + rb @ rb
            if square <= enough * enough:
                break
            turn = square / before
            db = rb + turn * db

        def losses(s, b=b, c=c, t=t):
            """The slope along the step, and the loss at every halving of it, at none last."""
            far, gfar = s["s"] + t * s["d"], s["gs"] + t * s["gd"]
            out = [(far * s["gg"]).sum()]
            for x in (*_HALVES, 0.0):
                ga = s["ga"] + x * gfar
                m = ga + b + x * c
                top = m.max(axis=1)
                out.append(0.5 * ((s["a"] + x * far) * ga).sum() + (s["weight"] * (
                    np.log(np.exp(m - top[:, None]).sum(axis=1)) + top - m[np.arange(len(m)), s["label"]])).sum())
            return np.array(out)

        sums = rows.total(losses)
        slope, now = sums[0] + c @ gb, sums[-1]
        along = next((x for x, loss in zip(_HALVES, sums[1:]) if loss <= now + 1e-4 * x * slope), _HALVES[-1])
        b = b + along * c
    else:
        return (lambda s: ended(s, t, along)["a"]), b, norm / (first or 1.0), step
    return (lambda s: s["a"]), b, norm / (first or 1.0), step


_HALVES = tuple(0.5 ** k for k in range(21))      # steps that are tried, down to 1e-6


def newton(gram, labels: np.ndarray, weights: np.ndarray, classes: int, tol: float = 1e-5, most: int = 30):
    """(numbers per row and class, intercepts, gradient norm relative to the first, Newton steps).

    Minimises half the squared weights plus the weighted log losses; intercepts are free.
    ``gram(x)`` is the Gram matrix of the rows times x. The norm is a root of products, so it
    cannot be told apart from zero below about 1e-8 of the first.
    """
    rows = _Here(gram, _started(labels, weights, classes, 1.0))
    numbers, b, norm, step = _fit(rows, classes, tol, most)
    return numbers(rows.state), b, norm, step


@dataclass(frozen=True)
class GramModel:
    """A fitted classifier: its table (gram, idf, weights by class) and what belongs to all of it."""
    spark: SparkSession
    path: str

    def grams(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, "grams"))

    def about(self):
        """labels, intercepts, gradient (relative), steps and passes of the fit."""
        return self.spark.read.parquet(os.path.join(self.path, "about")).first()


def fit_text_classifier(labelled: DataFrame, split: str = "dev", label: str = "label", text: str = "text",
                        min_df: float = 1.0, max_rows: int | None = None, tol: float = 1e-5,
                        path: str | None = None) -> GramModel:
    """M2: word 1- and 2-grams, sublinear tf, smooth idf, unit rows, class-balanced multinomial fit.

    Reads one split only; a row of another split fails the job. Equal texts of a label are one row that counts as
    often as it stands. All of them are learned from, and grams in fewer than ``min_df`` texts are cut; a
    caller that asks for ``max_rows`` gets about as many rows, drawn by a hash. The fit ends when the gradient has
    fallen to ``tol`` of the first one.
    """
    spark = labelled.sparkSession
    path = path or scratch_path(spark, "classifier")
    rows = (only_split(labelled, split).filter(F.col(label).isNotNull())
            .groupBy(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")))
    if max_rows is not None:
        rows = materialise(rows, "labelled")
        share = min(1.0, max_rows / max(1, rows.count()))
        rows = rows.filter(F.pmod(F.xxhash64("text", "label"), F.lit(1 << 20)) < share * (1 << 20))
    train = _stored(rows.select(F.monotonically_increasing_id().alias("row"), "label", "n", words_of(F.col("text")).alias("words")),
                    "train")
    known = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    names = sorted(known)
    if len(names) < 2:
        raise ValueError("fewer than two classes to learn")
    texts = sum(known.values())
    bits = min(16, max(0, (NUMBERS // len(names)).bit_length() - 1))
    cut = F.shiftright("row", bits)
    # rows of a partition are numbered on from its first, so a row block has no gaps
    found = train.groupBy(cut.alias("cut")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("words")).alias("words")).orderBy("cut").collect()
    starts = np.array([r["cut"] << bits for r in found], np.int64)
    # a class counts as much as any other
    codes, heavy = {x: i for i, x in enumerate(names)}, np.array([texts / (len(names) * known[x]) for x in names])

    def packed(table):
        table = table.sort_by("row")
        label = np.array([codes[x] for x in table.column("label").to_pylist()], np.int32)
        at = int(np.searchsorted(starts, table.column("row")[0].as_py(), "right")) - 1
        return pa.Table.from_arrays([pa.array([at], pa.int32()), *_packed(label, table.column("n").to_numpy() * heavy[label])], names=["at", "label", "weight"])

    labels = train.select("row", "label", "n", cut.alias("cut")).groupBy("cut").applyInArrow(packed, "at int, label binary, weight binary")
    blocks = gram_blocks(train, _number_blocks(2 * sum(r["words"] for r in found), MOST), starts, texts, min_df)
    apart = _Apart(blocks, labels, len(names), [r["rows"] for r in found])
    numbers, intercepts, gradient, steps = _fit(apart, len(names), tol)
    weights = spark.createDataFrame(apart.weights(numbers), "block int, weights binary")

    def weigh(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = pa.array(_read(batch, "weights", i, np.float64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("grams")[i].values, pa.array(_read(batch, "idf", i, np.float64)),
                     pa.FixedSizeListArray.from_arrays(own, len(names)).cast(pa.list_(pa.float64()))],
                    names=["gram", "idf", "weights"])

    blocks.select("block", "grams", "idf").join(weights, "block").mapInArrow(weigh, "gram string, idf double, weights array<double>") \
        .write.parquet(os.path.join(path, "grams"))
    apart.close()
    spark.createDataFrame([(names, intercepts.tolist(), float(gradient), steps, apart.passes)],
                          "labels array<string>, intercepts array<double>, gradient double, steps int, passes int") \
        .write.parquet(os.path.join(path, "about"))
    return GramModel(spark, path)


def load_or_fit_classifier(spark: SparkSession, path: str, fit) -> GramModel:
    """IO9: the model stored at ``path``, or the one that ``fit(path)`` stores there."""
    model = GramModel(spark, path)
    try:
        model.about()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        model = fit(path)
    return model


def classify_text(model: GramModel, items: DataFrame, text: str = "text") -> DataFrame:
    """M2: items with ``pred``, its probability as ``confidence``, and ``probabilities`` by class.

    A model of ``HELD`` numbers at most is held by every task, which keeps two numbers for a gram instead of its
    text. For a larger one items are stored once and numbered; their grams meet the model's in blocks by gram, and what
    the blocks say of a run of items is added up. A task looks at ``WORDS`` words at a time. A text without a known
    gram is judged by the intercepts.
    """
    about, size = model.about(), model.grams().count()
    names, intercepts = pa.array(about["labels"]), np.array(about["intercepts"])
    return (_judged_beside if size * (len(names) + 3) <= HELD else _judged_apart)(model, items, text, names, intercepts, size)


def _judged_beside(model: GramModel, items: DataFrame, text: str, names: pa.Array, intercepts: np.ndarray, size: int) -> DataFrame:
    table = model.grams().toArrow().combine_chunks()
    shared = items.sparkSession.sparkContext.broadcast((
        _Lookup(table.column("gram").combine_chunks()), table.column("idf").to_numpy(),
        np.array(table.column("weights").combine_chunks().flatten()).reshape(size, -1)))
    out = T.StructType([*items.schema.fields, T.StructField("pred", T.StringType()), T.StructField("confidence", T.DoubleType()),
                        T.StructField("probabilities", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(out)

    def run(batches):
        grams, idf, weights = shared.value
        for batch in (part for whole in batches for part in _parts(whole, "_words", WORDS)):
            n = batch.num_rows
            code, row, tf = _counted(*grams.of(batch.column(batch.num_columns - 1)), n)
            value = (1 + np.log(tf)) * idf[code]
            square = np.bincount(row, value * value, n)
            margins = np.stack([np.bincount(row, value * weights[code, c], n) for c in range(len(names))], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_answers(square, margins, names, intercepts)], schema=arrow)

    return items.withColumn("_words", words_of(F.col(text))).mapInArrow(run, out)


def _answers(square: np.ndarray, margins: np.ndarray, names: pa.Array, intercepts: np.ndarray) -> list[pa.Array]:
    p = _softmax(margins / np.sqrt(np.where(square > 0, square, 1.0))[:, None] + intercepts)
    best = p.argmax(axis=1)
    return [names.take(pa.array(best)), pa.array(p[np.arange(len(p)), best]),
            pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(names)).cast(pa.list_(pa.field("element", pa.float64())))]


def _judged_apart(model: GramModel, items: DataFrame, text: str, names: pa.Array, intercepts: np.ndarray, size: int) -> DataFrame:
    stored = _stored(items.withColumn("_row", F.monotonically_increasing_id()), "asked")
    # a gram for three characters
    blocks = max(_number_blocks((stored.agg(F.sum(F.length(text))).first()[0] or 0) // 3, JUDGED), -(-size // (4 * LEAST)))
    sieve = items.sparkSession.sparkContext.broadcast(_sieve(model.grams(), size))

    def place(batches):
        for batch in batches:
            at = pa.array((_hashed(batch.column("gram")) % np.uint64(blocks)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([at, *batch.columns], names=["block", "gram", "idf", "weights"])

    known = model.grams().select("gram", "idf", "weights").mapInArrow(place, "block int, gram string, idf double, weights array<double>")

    def judge(texts, known):
        grams = known.column("gram").combine_chunks()
        idf = known.column("idf").to_numpy()
        weights = known.column("weights").combine_chunks().flatten().to_numpy().reshape(len(idf), len(names))
        lists = texts.column("grams").combine_chunks()
        code = pc.fill_null(pc.index_in(lists.flatten(), grams), -1).to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
        margins, squares = [], []
        for i in range(texts.num_rows):
            n = texts.column("size")[i].as_py()
            gram = np.repeat(code[edges[i]:edges[i + 1]], _read(texts, "counts", i, np.int32))
            row, tf = _entries(*(texts.column(c)[i].as_buffer() for c in ("rows", "tf")))
            hit = gram >= 0
            gram, row = gram[hit], row[hit].astype(np.intp)
            value = (1 + np.log(tf[hit].astype(float))) * idf[gram]
            squares.append(np.bincount(row, value * value, n).tobytes())
            margins.append(np.stack([np.bincount(row, value * weights[gram, c], n) for c in range(len(names))], axis=1).tobytes())
        return pa.Table.from_arrays([texts.column("base"), texts.column("size"), pa.array(squares, pa.binary()), pa.array(margins, pa.binary())],
                                    names=["base", "size", "squares", "margins"])

    def add(table):
        rows = range(table.num_rows)
        square = sum(_read(table, "squares", i, np.float64) for i in rows)
        margins = sum(_read(table, "margins", i, np.float64) for i in rows).reshape(len(square), -1)
        return pa.Table.from_arrays([pa.array(table.column("base")[0].as_py() + np.arange(len(square))), *_answers(square, margins, names, intercepts)],
                                    names=["_row", "pred", "confidence", "probabilities"])

    asked = _spread(stored.select(F.col("_row").alias("row"), F.lit(1).cast("long").alias("n"), words_of(F.col(text)).alias("words")), blocks, sieve)
    judged = (asked.groupBy("block").cogroup(known.groupBy("block"))
              .applyInArrow(judge, "base long, size int, squares binary, margins binary")
              .groupBy("base").applyInArrow(add, "_row long, pred string, confidence double, probabilities array<double>"))
    return stored.join(judged, "_row").select(*items.columns, "pred", "confidence", "probabilities")
