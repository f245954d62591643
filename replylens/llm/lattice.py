"""Subword lattice likelihood: the probability of a text over all its segmentations.

The pieces are those of an existing vocabulary file. The one installed stores merge ranks
where a unigram vocabulary would store log probabilities, so the unigram weights of its
pieces are estimated here from the training texts: every training word is segmented once
by the vocabulary, and its pieces are counted as often as the word occurs.

Pieces do not cross words, so the lattice of a text falls apart into the lattices of its
words, and the marginal log probability of a text is the sum of those of its words plus
that of the end. The forward recursion therefore runs once per distinct word of the
corpus, on a table that Spark shuffles by word, and never once per occurrence.

Texts meet word tables in blocks: documents are dealt into blocks of about equal size, the
distinct words of a block are joined with the word table, and block and words come
together in one group of bounded size. A word has one row per block at most, however
often it occurs.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import id_remainder, pieces_of, stored

END = ""                # no word is empty, so the empty string stands for the end
SMOOTH = 0.1
BLOCK_CHARS = 16_000_000
BLOCK_ROWS = 200_000


_TOKEN_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def tokens_of(text: str | None) -> list[str]:
    """Runs without ASCII white space, A-Z lower-cased."""
    if not text:
        return []
    text = text.encode("utf-8", "surrogatepass").translate(_TOKEN_BYTES).decode("utf-8", "surrogatepass").strip(" ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.split(" ") if text else []


@lru_cache(maxsize=2)
def vocabulary(path: str):
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=path)


def piece_counts(words: DataFrame, model_path: str) -> dict[int, float]:
    """Occurrences of every piece in the training words; as many entries as the vocabulary."""
    def run(batches):
        sp = vocabulary(model_path)
        total: Counter = Counter()
        for batch in batches:
            words, times = batch.column("word").to_pylist(), batch.column("c").to_pylist()
            for pieces, n in zip(sp.encode(words, num_threads=1), times):
                for piece in pieces:
                    total[piece] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                          pa.array(list(total.values()), pa.int64())],
                                         names=["piece", "n"])

    counted = words.mapInArrow(run, "piece int, n long")
    return {r["piece"]: r["n"] for r in counted.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


class Lattice:
    """Marginal log10 probabilities of words under unigram piece weights."""

    def __init__(self, weights: dict[str, float], byte_weights: list[float]):
        self.weights, self.bytes = weights, byte_weights
        self.longest = max(map(len, weights), default=1)
        self.prefixes = {p[:n] for p in weights for n in range(1, len(p))}

    def word(self, word: str) -> float:
        """log10 of the summed probability of every segmentation of one word.

        ``forward`` is the log probability of the characters so far; ``arrive[j]`` holds
        what pieces bring to place j. A character without a piece is spelled in bytes.
        """
        text = "▁" + word
        weights, prefixes, longest = self.weights, self.prefixes, self.longest
        size = len(text)
        arrive: list[list[float]] = [[] for _ in range(size + 1)]
        forward = 0.0
        for i in range(size):
            for j in range(i + 1, min(size, i + longest) + 1):
                piece = text[i:j]
                w = weights.get(piece)
                if w is not None:
                    arrive[j].append(forward + w)
                elif j == i + 1:
                    spelled = piece.encode("utf-8", "surrogatepass")
                    arrive[j].append(forward + sum([self.bytes[b] for b in spelled]))
                    if piece not in prefixes:
                        break
                elif piece not in prefixes:
                    break
            terms, arrive[i + 1] = arrive[i + 1], []
            top = max(terms)
            forward = top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms]))
        return forward / math.log(10)


def fit_pieces(counts: dict[int, float], ends: int, model_path: str) -> tuple[dict, list, float]:
    """Natural-log weights of pieces and bytes, and log10 of the end, add-0.1 smoothed."""
    sp = vocabulary(model_path)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    total = sum(counts.get(i, 0) for i in usable) + ends + SMOOTH * (len(usable) + 1)
    weights, spelled = {}, [0.0] * 256
    for i in usable:
        w = math.log((counts.get(i, 0) + SMOOTH) / total)
        if sp.is_byte(i):
            spelled[int(sp.id_to_piece(i)[3:5], 16)] = w
        else:
            weights[sp.id_to_piece(i)] = w
    return weights, spelled, math.log10((ends + SMOOTH) / total)


def deal(docs: DataFrame, blocks: int) -> DataFrame:
    """Every row with a block number, by its key and its place in the table."""
    placed = docs.withColumn("_place", F.monotonically_increasing_id())
    return placed.select(F.pmod(F.xxhash64("doc_id", "text", "_place"), F.lit(blocks)).alias("block"),
                         "doc_id", "held_out", "text")


def score_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                modulus: int = 10, block_chars: int = BLOCK_CHARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Lattice and word-model log10 probabilities of every text, one row per input row.

    Learns from rows whose crc32(id as text) mod ``modulus`` is not 0. Columns: doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score. A null or empty text is
    its end alone. A null id counts as the empty text in the remainder. Repeated rows
    count as often as they stand. An empty table gives no rows.

    Texts are scored in blocks of about ``block_chars`` characters and ``block_rows`` rows at most. Rows are
    dealt to them by key and place, so that repeated rows spread like all others; a table read
    again gives every row its former place.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    docs = docs.withColumn("held_out", id_remainder("doc_id", modulus) == 0)
    size = docs.agg(F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    blocks = max(1, -(-(size["n"] or 0) // block_chars), -(-size["rows"] // block_rows))

    def count(batches):
        total: Counter = Counter()
        ends = 0
        for batch in pieces_of(batches):
            for text in batch.column("text").to_pylist():
                total.update(tokens_of(text))
                ends += 1
            if len(total) > 300_000:
                yield rows(total)
                total.clear()
        total[END] = ends
        yield rows(total)

    def rows(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()),
                                           pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    words = stored(docs.filter("not held_out").select("text").mapInArrow(count, "word string, n long")
                   .groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "words")
    size = words.agg(F.sum("c").alias("tokens"), F.count("*").alias("v"),
                     F.sum(F.when(F.col("word") == END, F.col("c"))).alias("ends")).first()
    tokens, kinds, ends = size["tokens"] or 0, size["v"], size["ends"] or 0
    weights, spelled, end_score = fit_pieces(piece_counts(words, model_path), ends, model_path)
    context = docs.sparkSession.sparkContext
    model = context.broadcast((weights, spelled))   # as large as the vocabulary file

    dealt = deal(docs, blocks).repartition(int(blocks), "block")

    def distinct(batches):
        found: dict[int, set] = {}
        for batch in pieces_of(batches):
            for b, text in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(b, set()).update(tokens_of(text))
        for b, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([b] * len(own), pa.int64()),
                                              pa.array(list(own), pa.string())], names=["block", "word"])

    def weigh(batches):
        lattice = Lattice(*model.value)
        for batch in batches:
            scores = [lattice.word(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             names=["word", "c", "score"])

    needed = dealt.mapInArrow(distinct, "block long, word string")
    weighed = words.filter(F.col("word") != END).mapInArrow(weigh, "word string, c long, score double")
    tables = needed.join(weighed, "word", "left").select("block", "word", "c", "score")
    denominator = tokens + SMOOTH * (kinds + 1)
    end_base = math.log10((ends + SMOOTH) / denominator) if denominator else 0.0

    def score(key, texts: pa.Table, table: pa.Table) -> pa.Table:
        names = table.column("word").to_pylist()
        place = dict(zip(names, range(len(names))))
        c = table.column("c").fill_null(0).to_numpy()
        base = np.log10((c + SMOOTH) / denominator)
        own, known = table.column("score").to_numpy().copy(), c > 0
        lattice = None
        for at in np.flatnonzero(~known):       # words that training never saw
            lattice = lattice or Lattice(*model.value)
            own[at] = lattice.word(names[at])
        out = [[], [], [], []]
        for text in texts.column("text"):
            found = tokens_of(text.as_py())
            at = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
            out[0].append(len(found) + 1)
            out[1].append(int(known[at].sum()) + (ends > 0))
            out[2].append(float(base[at].sum()) + end_base)
            out[3].append(float(own[at].sum()) + end_score)
        return pa.table([texts.column("doc_id"), texts.column("held_out"), pa.array(out[0], pa.int64()),
                         pa.array(out[1], pa.int64()), pa.array([tokens] * len(out[0]), pa.int64()),
                         pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
                               "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (dealt.groupBy("block").cogroup(tables.groupBy("block"))
            .applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
                                 "train_tokens long, base_score double, score double"))
