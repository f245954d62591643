"""A stored BM25 index: postings by term and span of blocks of passages, skipped by upper bounds.

Passages are cut into spans where they are read; a span holds at most ``BLOCK`` of them, or one
block if that is larger. The passages of a span, in order, are cut into its blocks.
A row of ``postings`` has the passages of one span that hold one term, the weight of the term
in each, and the largest of these weights in the span and in each block. From them follows the most
that any passage can score there, before any posting is read. However small blocks are, the
rows are those of the spans.

A search reads the bounds first. They give a floor under the k-th score, and spans that cannot
reach it are not read; in those that are, blocks that cannot are passed over. A task raises the floor of a query by
what its earlier spans gave. Inside a
block terms are taken from the largest possible gain down: once the terms left cannot lift a new
passage to the floor, only passages already met are looked up in the remaining lists. All of
this keeps every passage that may be among the best k, so results are exact.

The texts are read once, when the index is built. In a search a span's postings move once,
however many queries meet it.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from replylens.functions import text as tx
from replylens.operators import bm25
from replylens.session import materialise, scratch_path

BLOCK = 1024                # passages of a span of blocks, at most, unless one block has more
TOKENS = 4_000_000          # and tokens, unless one passage has more
QUERIES = 65_536            # queries that one copy of a span's postings serves
CELLS = 4_000_000           # scores that are held at a time
REACHED = 200_000           # queries whose scores a task remembers from span to span
# A score is rounded to three places; a bound this far below the floor cannot reach it.
SLACK = 0.0005 + 1e-9


@dataclass(frozen=True)
class TextIndex:
    """The tables of an index: ``postings`` and ``spans``."""
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, name))


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ``values`` between consecutive ``ends`` as one binary value each."""
    ends = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())])


def _unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(ends, values) of a column made by ``_packed``; nulls are empty."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    return (ends - ends[0]) // np.dtype(kind).itemsize, values.view(kind)


def _runs(ends: np.ndarray, places: np.ndarray, block_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of rising places cut at blocks: (start of every run, its block, ends of the lists in runs)."""
    width = int(places.max(initial=0)) // block_docs + 1
    key = np.repeat(np.arange(len(ends) - 1) * width, np.diff(ends)) + places // block_docs
    cut = np.flatnonzero(np.diff(key, prepend=-1))
    return cut, key[cut] % width, np.searchsorted(cut, ends)


def _maxima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The largest value from every start to the next."""
    return np.maximum.reduceat(values, starts) if len(values) else np.zeros(0)


def _span_rows(docs: DataFrame, doc_order: str, text: str, span_docs: int) -> DataFrame:
    """Per span a row for itself (null term: ids in order, lengths) and one per term.

    ``n`` passages hold the term; ``at`` are their places in the span's ids, ``tf`` the occurrences
    and ``lens`` the lengths there, packed as 32-bit integers.
    """
    source = docs.select(F.col(doc_order).alias("id"),
                         F.coalesce(tx.tokens(F.col(text)), F.array().cast("array<string>")).alias("t"))
    schema = T.StructType([T.StructField("span", T.LongType()), T.StructField("term", T.StringType()),
                           T.StructField("ids", T.ArrayType(source.schema["id"].dataType)),
                           T.StructField("n", T.IntegerType()), T.StructField("tokens", T.LongType()),
                           *[T.StructField(c, T.BinaryType()) for c in ("at", "tf", "lens")]])
    arrow = to_arrow_schema(schema)

    def emit(held: list[pa.RecordBatch], span: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by("id").combine_chunks()
        lists = rows.column("t").chunk(0)
        lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.dictionary_encode(lists.flatten())
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, tf = np.unique(code * len(lens) + np.repeat(np.arange(len(lens)), lens), return_counts=True)
        code, at = np.divmod(pair, max(1, len(lens)))
        n = np.bincount(code, minlength=len(words.dictionary))
        # the span itself comes first: no term, all passages
        ends = np.r_[0, 0, np.cumsum(n)]
        ids = pa.ListArray.from_arrays(pa.array([0] + [len(lens)] * len(ends[1:]), pa.int32()), rows.column("id").chunk(0))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n) + 1, span)), pa.concat_arrays([pa.nulls(1, pa.string()), words.dictionary.cast(pa.string())]),
             ids.cast(arrow.field("ids").type), pa.array(np.r_[len(lens), n].astype(np.int32)),
             pa.array(np.r_[lens.sum(), np.zeros(len(n))].astype(np.int64)),
             *(_packed(c.astype(np.int32), ends) for c in (at, tf, lens[at]))], schema=arrow)

    def run(batches):
        from pyspark import TaskContext
        span, held, rows, tokens = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            sizes = pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False)
            start = 0
            for row, size in enumerate(sizes):
                if rows and (rows == span_docs or tokens + size > TOKENS):
                    held.append(batch.slice(start, row - start))
                    yield emit(held, span)
                    span, held, rows, tokens, start = span + 1, [], 0, 0, row
                rows, tokens = rows + 1, tokens + int(size)
            held.append(batch.slice(start))
        if rows:
            yield emit(held, span)

    return source.mapInArrow(run, schema)


def build_index(docs: DataFrame, path: str | None = None, doc_order: str = "doc_id", text: str = "text",
                block_docs: int = BLOCK) -> TextIndex:
    """Store the index of ``docs`` below ``path`` and return it.

    ``doc_order`` is unique and gives the order of equal scores. A null text is a passage without
    tokens. Bounds are stored for blocks of ``block_docs`` passages. Postings are stored where their span was cut,
    so building an index shuffles nothing and a term in very many passages fills many files.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "textindex")
    index = TextIndex(spark, path)
    rows = materialise(_span_rows(docs, doc_order, text, max(1, BLOCK // block_docs) * block_docs), "postings")
    (rows.filter("term is null").select("span", "ids", F.lit(block_docs).alias("each"), "n", "tokens")
     .write.parquet(os.path.join(path, "spans")))
    _, average = corpus_size(index)

    def weigh(batches):
        for batch in batches:
            (ends, at), (_, tf) = (_unpacked(batch.column(c), np.int32) for c in ("at", "tf"))
            shape = bm25.K1 * (1 - bm25.B + bm25.B * _unpacked(batch.column("lens"), np.int32)[1] / average)
            weights = tf * (bm25.K1 + 1) / (tf + shape)
            cut, blocks, own = _runs(ends, at, block_docs)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("term", "span", "n")), pa.array(_maxima(weights, ends[:-1])),
                 _packed(blocks.astype(np.int32), own), _packed(_maxima(weights, cut), own),
                 batch.column("at"), _packed(weights, ends)],
                names=["term", "span", "n", "most", "blocks", "mosts", "at", "weights"])

    (rows.filter("term is not null").select("term", "span", "n", "at", "tf", "lens")
     .mapInArrow(weigh, "term string, span long, n int, most double, blocks binary, mosts binary, at binary, weights binary")
     .write.parquet(os.path.join(path, "postings")))
    return index


def corpus_size(index: TextIndex) -> tuple[int, float]:
    """Passages, and their mean number of tokens (1 if there are none)."""
    found = index.table("spans").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).first()
    return found["n"] or 0, found["tokens"] / found["n"] if found["tokens"] else 1.0


def _asked(queries: DataFrame, index: TextIndex, query_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Terms of the queries, and the sizes and maxima of their postings with their idf.

    Distinct terms meet the postings, so a term of very many queries is no hot key there.
    """
    asked = materialise(bm25.query_terms(queries, query_id, text), "terms")
    # several steps read the bounds of these terms, a row per span
    held = materialise(index.table("postings").select("term", "span", "n", "most", "blocks", "mosts")
                       .join(asked.select("term").distinct(), "term", "left_semi"), "held")
    n_docs, _ = corpus_size(index)
    weight = held.groupBy("term").agg(F.sum("n").alias("df")).select(
        "term", bm25.idf(F.lit(n_docs), F.col("df")).alias("idf"))
    return asked, held.join(weight, "term")


def _block_tops(held: DataFrame, k: int | None = None) -> DataFrame:
    """(term, span, block, idf, most): every block of the rows of ``held``, or the best ``k`` of each."""
    def run(batches):
        for batch in batches:
            (ends, blocks), (_, mosts) = _unpacked(batch.column("blocks"), np.int32), _unpacked(batch.column("mosts"), np.float64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            order = np.lexsort((-mosts, row))       # rows keep their places, so ends hold
            order = order[np.arange(len(order)) - ends[row] < (len(order) if k is None else k)]
            own = pa.array(row[order])
            yield pa.RecordBatch.from_arrays(
                [batch.column("term").take(own), batch.column("span").take(own), pa.array(blocks[order]),
                 batch.column("idf").take(own), pa.array(mosts[order])], names=["term", "span", "block", "idf", "most"])

    return held.select("term", "span", "idf", "blocks", "mosts").mapInArrow(
        run, "term string, span long, block int, idf double, most double")


def span_bounds(asked: DataFrame, held: DataFrame, query_id: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (query_id, span, bound, terms, floor) worth scoring, and all pairs without the floor.

    ``bound`` is the most a passage of the span can score for the query, ``terms`` are (term, idf). The best passage
    of a block scores at least its largest single gain, so the k-th largest of these over all
    blocks is a ``floor`` under the k-th score; pairs whose bound is below it are left out. The k blocks best
    by a term are enough for it: a block beside them has k others at least as good.
    Of the postings only sizes and maxima are read.
    """
    pairs = materialise(
        asked.join(held.select("term", "span", "idf", "most"), "term").groupBy(query_id, "span")
        .agg(F.sum(F.col("idf") * F.col("most")).alias("bound"),
             F.collect_list(F.struct("term", "idf")).alias("terms")), "bounds")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("most"), "span", "block"))
    tops = _block_tops(held, k).withColumn("place", place).filter(F.col("place") <= k)
    singles = asked.join(tops, "term").groupBy(query_id, "span", "block").agg(F.max(F.col("idf") * F.col("most")).alias("single"))
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("single")))
    floors = (singles.select(query_id, "single").withColumn("place", place).filter(F.col("place") <= k)
              .groupBy(query_id).agg(F.when(F.count("*") == k, F.min("single")).alias("least")))
    worth = (pairs.join(floors, query_id).withColumn("floor", F.coalesce("least", F.lit(0.0)))
             .filter(F.col("bound") >= F.col("floor") - SLACK))
    return worth, pairs


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _pieces(counts: np.ndarray):
    """Ranges of entries that together have about ``CELLS`` items, one entry at least."""
    reach, lo = np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(reach, reach[lo] - counts[lo] + CELLS, "right")))
        yield slice(lo, hi)
        lo = hi


class SpanPostings:
    """The needed postings of one span: lists one after the other, places rising in each, cut at blocks of ``each``."""

    def __init__(self, ids: pa.Array, each: int):
        self.ids, self.each, self.blocks = ids, each, -(-len(ids) // each)
        self.codes: dict[str, int] = {}
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, term: str, places: np.ndarray, weights: np.ndarray) -> None:
        self.codes[term] = len(self.lists)
        self.lists.append((places, weights))

    def ready(self) -> None:
        if self.lists is not None:
            places, self.weight = (np.concatenate(c) for c in zip(*self.lists))
            ends = np.r_[0, np.cumsum([len(p) for p, _ in self.lists])]
            cut, self.block, self.first = _runs(ends, places.astype(np.int64), self.each)
            self.start, self.lists = np.r_[cut, len(places)], None
            self.most = _maxima(self.weight, cut)
            self.place = places.astype(np.int64) % self.each
            self.key = np.repeat(np.arange(len(cut)), np.diff(self.start)) * self.each + self.place

    def best(self, owner, code, idf, floor: np.ndarray, k: int):
        """Best k passages of every query: (query, place, rounded score), and postings read by query.

        An entry is a term of the query ``owner``; ``floor`` is what the k-th best is known to reach.
        Passages below it may be missing. Blocks whose bound is below it are passed over.
        """
        self.ready()
        runs = self.first[code + 1] - self.first[code]
        run, idf = _spread(self.first[code], runs), np.repeat(idf, runs)
        cell, gain = np.repeat(owner, runs) * self.blocks + self.block[run], idf * self.most[run]
        bound = np.bincount(cell, gain, len(floor) * self.blocks)
        live = (bound > 0) & (bound >= np.repeat(floor, self.blocks) - SLACK)
        pair, kept = np.flatnonzero(live), live[cell]
        asked, block = np.divmod(pair, self.blocks)
        own, place, rounded, read = self._best((np.cumsum(live) - 1)[cell[kept]], run[kept], idf[kept], gain[kept], floor[asked], k)
        query, place = asked[own], block[own] * self.each + place
        order = np.lexsort((place, -rounded, query))
        order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
        return query[order], place[order], rounded[order], np.bincount(asked, read, len(floor))

    def _best(self, owner, code, idf, gain, floor: np.ndarray, k: int):
        """The same for pairs of query and block; an entry is the run of a term in the block."""
        m, n = len(floor), self.each
        order = np.lexsort((-gain, owner))
        owner, code, idf, gain = owner[order], code[order], idf[order], gain[order]
        whole = np.bincount(owner, gain, m)
        first = np.searchsorted(owner, np.arange(m + 1))
        before = np.r_[0.0, np.cumsum(gain)]
        ahead = whole[owner] - (before[:-1] - before[first[owner]])     # gain of this and all later terms
        able = ahead >= floor[owner] - SLACK        # a passage first met here could still reach the floor
        size = self.start[code + 1] - self.start[code]
        read = np.bincount(owner, np.where(able, size, 0), m)
        score, at = np.zeros(m * n), np.flatnonzero(able)
        for piece in _pieces(size[at]):
            e = at[piece]
            slot = _spread(self.start[code[e]], size[e])
            score += np.bincount(np.repeat(owner[e] * n, size[e]) + self.place[slot],
                                 np.repeat(idf[e], size[e]) * self.weight[slot], m * n)
        # passages met so far that the other terms can lift to the floor
        split = first[:-1] + np.bincount(owner, able, m).astype(np.int64)
        rest = np.where(split < first[1:], np.r_[ahead, 0.0][split], 0.0)
        cell = np.flatnonzero(score.reshape(m, n) >= np.maximum(floor - SLACK - rest, 1e-300)[:, None])
        query, total = cell // n, score[cell]
        others = (first[1:] - split)[query]
        for piece in _pieces(others):
            entry = _spread(split[query[piece]], others[piece])
            own = np.repeat(np.arange(piece.stop - piece.start), others[piece])
            wanted = code[entry] * n + (cell[piece] % n)[own]
            where = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = np.flatnonzero(self.key[where] == wanted)
            total[piece] += np.bincount(own[hit], idf[entry[hit]] * self.weight[where[hit]], piece.stop - piece.start)
            read += np.bincount(query[piece][own[hit]], minlength=m)
        rounded = np.floor(total * 1000 + 0.5) / 1000
        order = np.lexsort((cell, -rounded))
        order = order[(rounded[order] > 0) & (rounded[order] >= floor[query[order]] - SLACK)]
        order = order[np.argsort(query[order], kind="stable")]
        order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
        return query[order], cell[order] % n, rounded[order], read


def _lists(column: pa.ListArray):
    """(offsets, values) of a list column."""
    return column.offsets.to_numpy().astype(np.int64), column.values


def _score_pairs(pairs: DataFrame, terms: DataFrame, index: TextIndex, k: int, query_id: str, copies: int) -> DataFrame:
    """(query_id, hit, score, read): the best k passages per pair of (query, span, terms, floor); ``terms`` are all theirs.

    Postings that some pair needs and the pairs of a span go to one task and meet as streams:
    first the span, then its queries, of which the task holds a batch at a time. Past
    ``QUERIES`` queries a span has copies. Every pair also gives a row without a hit, which counts the
    postings read for it.
    """
    salt = F.pmod(F.xxhash64(query_id), F.lit(copies)).cast("int")
    asked = pairs.select("span", salt.alias("copy"), F.col(query_id).alias("query"), "terms", "floor")
    needed = asked.select("span", "copy", F.explode("terms.term").alias("term")).distinct()
    # lists of other terms leave before anything is dealt out
    wanted = (index.table("postings").select("span", "term", "at", "weights").join(terms, "term", "left_semi")
              .join(needed, ["span", "term"]))
    members = index.table("spans").join(asked.select("span", "copy").distinct(), "span")
    stream = (members.select("span", "copy", F.lit(0).alias("kind"), "ids", "each")
              .unionByName(wanted.withColumn("kind", F.lit(1)), True)
              .unionByName(asked.withColumn("kind", F.lit(2)), True)
              .repartition("span", "copy").sortWithinPartitions("span", "copy", "kind")
              .select("span", "copy", "kind", "ids", "each", "term", "at", "weights", "query", "terms", "floor"))
    out = T.StructType([T.StructField(query_id, pairs.schema[query_id].dataType),
                        T.StructField("hit", stream.schema["ids"].dataType.elementType),
                        T.StructField("score", T.DoubleType()), T.StructField("read", T.LongType())])
    arrow = to_arrow_schema(out)

    def answers(span: SpanPostings, batch, lo: int, hi: int, reached: dict):
        """The finds of the queries in rows ``lo`` to ``hi`` of a batch, all of one span.

        ``reached`` has the best k scores that earlier spans of the task gave a query, for as many
        queries as fit; the k-th is a floor for later spans.
        """
        size = np.diff(_lists(batch.column("terms").slice(lo, hi - lo))[0])
        for part in _pieces(np.maximum(size * span.blocks, len(span.ids) + span.each)):
            rows = batch.slice(lo + part.start, part.stop - part.start)
            ends, own = _lists(rows.column("terms"))
            own = own.slice(ends[0], ends[-1] - ends[0])
            code = np.array([span.codes[t] for t in own.field("term").to_pylist()], np.int64)
            names = rows.column("query").to_pylist()
            floor = np.maximum(rows.column("floor").to_numpy(zero_copy_only=False),
                               [s[-1] if len(s := reached.get(str(q), ())) == k else 0.0 for q in names])
            query, place, score, read = span.best(
                np.repeat(np.arange(rows.num_rows), np.diff(ends)), code,
                own.field("idf").to_numpy(zero_copy_only=False), floor, k)
            first = np.searchsorted(query, np.arange(rows.num_rows + 1))
            for i, q in enumerate(map(str, names)):
                if first[i] < first[i + 1] and (q in reached or len(reached) < REACHED):
                    reached[q] = sorted([*reached.get(q, ()), *score[first[i]:first[i + 1]].tolist()], reverse=True)[:k]
            # what was read stands in a row of its own
            n = rows.num_rows
            asked = rows.column("query")
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([asked.take(pa.array(query)), asked]),
                 pa.concat_arrays([span.ids.take(pa.array(place)), pa.nulls(n, span.ids.type)]),
                 pa.concat_arrays([pa.array(score), pa.nulls(n, pa.float64())]),
                 pa.array(np.r_[np.zeros(len(query)), read].astype(np.int64))], schema=arrow)

    def run(batches):
        span, reached = None, {}
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("span", "copy", "kind")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            (ends, at), (_, weights) = _unpacked(batch.column("at"), np.int32), _unpacked(batch.column("weights"), np.float64)
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if keys[2, lo] == 0:        # a span's own row comes first
                    span = SpanPostings(batch.column("ids")[lo].values, batch.column("each")[lo].as_py())
                elif keys[2, lo] == 1:
                    for row, term in enumerate(batch.column("term").slice(lo, hi - lo).to_pylist(), lo):
                        part = slice(ends[row], ends[row + 1])
                        span.add(term, at[part], weights[part])
                else:
                    yield from answers(span, batch, lo, hi, reached)

    return stream.mapInArrow(run, out)


def _ranked(found: DataFrame, query_id: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc("hit")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _scored(asked: DataFrame, held: DataFrame, index: TextIndex, k: int, query_id: str) -> DataFrame:
    """The finds of every scored pair."""
    worth, pairs = span_bounds(asked, held, query_id, k)
    most = pairs.groupBy("span").count().agg(F.max("count")).first()[0] or 0
    return _score_pairs(worth, asked.select("term").distinct(), index, k, query_id, max(1, -(-most // QUERIES)))


def search(queries: DataFrame, index: TextIndex, k: int = bm25.TOP, query_id: str = "query_id",
           doc_order: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc_order, score, rank), the best passages by rounded score, then order.

    ``query_id`` is unique. The index alone is read. Queries without a known term find nothing.
    """
    found = _scored(*_asked(queries, index, query_id, text), index, k, query_id)
    found = found.filter("hit is not null").select(query_id, "hit", "score")
    return _ranked(found, query_id, k).withColumnRenamed("hit", doc_order)


def search_effort(queries: DataFrame, index: TextIndex, k: int = bm25.TOP, query_id: str = "query_id",
                  text: str = "text") -> DataFrame:
    """One row: pairs of query and block, postings of the queries' terms, postings read for a score."""
    asked, held = _asked(queries, index, query_id, text)
    read = _scored(asked, held, index, k, query_id).agg(F.sum("read").alias("postings_read")).first()[0]
    pairs = asked.join(_block_tops(held), "term").select(query_id, "span", "block").distinct().count()
    return asked.join(held, "term").agg(F.sum("n").alias("postings")).withColumns(
        {"pairs": F.lit(pairs), "postings_read": F.lit(read)})


# Passages that are held in memory by every task: rows, and tokens of all of them.
HELD_ROWS, HELD_TOKENS = 65_536, 4_000_000


class HeldPassages:
    """An inverted index of a bounded set of passages: gains (idf by weight) by term."""

    def __init__(self, rows: pa.Table):
        """``rows``: (ord, id, t) in the order of ``ord``."""
        rows = rows.combine_chunks()
        self.n = rows.num_rows
        self.ids = rows.column("id").chunk(0) if self.n else None
        if not self.n:
            return
        lists = rows.column("t").chunk(0)
        lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.dictionary_encode(lists.flatten())
        self.vocabulary = words.dictionary
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, tf = np.unique(code * self.n + np.repeat(np.arange(self.n), lens), return_counts=True)
        code, self.doc = np.divmod(pair, self.n)
        df = np.bincount(code, minlength=len(self.vocabulary))
        self.start = np.r_[0, np.cumsum(df)]
        shape = bm25.K1 * (1 - bm25.B + bm25.B * lens / max(lens.mean(), 1e-300))
        idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        self.gain = idf[code] * (tf * (bm25.K1 + 1) / (tf + shape[self.doc]))

    def evidence(self, asked: pa.ListArray, k: int, kind: pa.DataType) -> pa.Array:
        """The best passages of every row of distinct terms, as a list of (id, score)."""
        parts, step = [], max(1, CELLS // max(1, self.n))
        for at in range(0, len(asked), step):
            parts.append(self._evidence(asked.slice(at, step), k, kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    def _evidence(self, asked: pa.ListArray, k: int, kind: pa.DataType) -> pa.Array:
        rows = len(asked)
        if not self.n:
            return pa.array([[]] * rows, kind)
        code = pc.index_in(asked.flatten(), self.vocabulary)
        known = code.is_valid().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(asked), 0).to_numpy(zero_copy_only=False))[known]
        code = code.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        fan = self.start[code + 1] - self.start[code]
        score = np.zeros(rows * self.n)
        for piece in _pieces(fan):
            slot = _spread(self.start[code[piece]], fan[piece])
            score += np.bincount(np.repeat(owner[piece] * self.n, fan[piece]) + self.doc[slot], self.gain[slot], len(score))
        score = np.floor(score * 1000 + 0.5).astype(np.int64).reshape(rows, self.n)
        # no two keys are equal: the score, then the earlier passage
        key = score * self.n + np.arange(self.n - 1, -1, -1)
        top = min(k, self.n)
        best = np.argpartition(key, self.n - top, axis=1)[:, self.n - top:]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(key, best, 1), axis=1), 1)
        found = np.take_along_axis(score, best, 1)
        some = found > 0
        items = pa.StructArray.from_arrays([self.ids.take(pa.array(best[some])), pa.array(found[some] / 1000)], ["id", "score"])
        ends = np.r_[0, np.cumsum(some.sum(axis=1))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), items).cast(kind)


def passage_evidence(messages: DataFrame, passages: DataFrame, k: int = bm25.TOP, message_id="request_id",
                     text: str = "message", previous: str | None = None) -> DataFrame:
    """J9, the live direction: many messages against a set of (ord, id, title, text) passages.

    Adds ``evidence``, array<struct<id, score>>, empty where nothing matches. ``message_id``
    names the columns that are unique together, and ``ord`` is unique. Passages are counted: up to
    ``HELD_ROWS`` of them with ``HELD_TOKENS`` tokens every task holds their index and the messages
    stream past it, so neither side is shuffled. A larger set is stored as an index and searched.
    """
    asked = F.col(text) if previous is None else F.concat_ws(" ", text, previous)
    whole = F.concat_ws(" ", "title", "text")
    docs = passages.select("ord", "id", tx.tokens(whole).alias("t"))
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("t").cast("long")).alias("tokens")).first()
    kind = T.ArrayType(T.StructType([T.StructField("id", passages.schema["id"].dataType),
                                     T.StructField("score", T.DoubleType())]))
    if size["rows"] <= HELD_ROWS and (size["tokens"] or 0) <= HELD_TOKENS:
        shared = messages.sparkSession.sparkContext.broadcast(HeldPassages(docs.orderBy("ord").toArrow()))
        out = T.StructType([*messages.schema.fields, T.StructField("evidence", kind)])
        arrow = to_arrow_schema(out)
        terms = F.coalesce(F.array_distinct(tx.tokens(asked)), F.array().cast("array<string>"))

        def run(batches):
            for batch in batches:
                found = shared.value.evidence(batch.column("_terms"), k, arrow.field("evidence").type)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], schema=arrow)

        return messages.withColumn("_terms", terms).mapInArrow(run, out)
    ids = [message_id] if isinstance(message_id, str) else list(message_id)
    index = build_index(passages.select("ord", whole.alias("text")), doc_order="ord")
    queries = messages.select(F.struct(*ids).alias("_query"), asked.alias("text"))
    hits = search(queries, index, k, "_query", "ord").join(passages.select("ord", "id"), "ord")
    found = hits.groupBy("_query").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("name"), "score"))),
        lambda h: F.struct(h["name"].alias("id"), h["score"].alias("score"))).alias("evidence"))
    return (messages.withColumn("_query", F.struct(*ids)).join(found, "_query", "left")
            .select(*messages.columns, F.coalesce("evidence", F.array().cast(kind)).alias("evidence")))
