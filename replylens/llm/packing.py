"""Packing of token sequences into as few bins as possible by swap-based local search.

Documents are tokenised where they lie and cut into pieces of at most the bin size; only
numbers travel from there. Pieces are dealt at random into groups of bounded size, and
each group is packed on its own: first by best fit, longest piece first, then by local
search between underfull bins. One bin of a group at most is wasted by dealing, which is
one in several thousand.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import pieces_of, stored

# Fixed value: how the vocabulary file splits a text before merging.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# White space to Python that is none to the vocabulary file.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
KEPT = 300_000


class Recent(dict):
    """A store of at most 2 * ``KEPT`` results; what was not used lately is let go."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


class WordEncoder:
    """Token ids of texts by a word-splitting vocabulary file.

    The vocabulary never joins characters over white space, so a text's ids are those of
    its stretches without white space, in order. Stretches and words are encoded once and
    looked up afterwards; the stores are bounded and never change a result.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.normal, self.model, self.letters = tokenizer.normalizer, tokenizer.model, byte_letters()
        self.word_ids = Recent(self._word)
        self.stretch_ids = Recent(self._stretch)

    def _word(self, word: str) -> bytes:
        spelled = word
        if not (word.isascii() and word.isalpha()):
            spelled = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _stretch(self, stretch: str) -> bytes:
        if stretch.isascii():
            text = stretch.lower()
        elif "\u03a3" in stretch:    # Python alone lower-cases a sigma by its neighbours
            text = self.normal.normalize_str(stretch)
        else:
            text = unicodedata.normalize("NFC", stretch).lower()
        if text.isalpha():              # the two plain cases, without the pattern
            return self.word_ids[text]
        if text[-1] in ".,;:!?" and text[:-1].isalpha():
            return self.word_ids[text[:-1]] + self.word_ids[text[-1]]
        return b"".join([self.word_ids[w] for w in SPLIT.findall(text)])

    def ids(self, text: str | None) -> np.ndarray:
        stretches = (text or "").split()
        if text and ODD_SPACE.search(text):
            stretches = regex.findall(r"\S+", text)
        return np.frombuffer(b"".join(map(self.stretch_ids.__getitem__, stretches)), dtype="<u4")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, so that its words last over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


PIECES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every text: (doc_id, piece, start, length, ids_crc32).

    A document is the ids of its whole text and then ``end_id``. It is cut only if it is
    longer than ``size``. A null or empty text is the end id alone.
    """
    def run(batches):
        enc = encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4")
        for batch in pieces_of(batches):
            rows: list[list] = [[], [], [], [], []]
            for n, text in enumerate(batch.column("text").to_pylist()):
                ids = np.concatenate([enc.ids(text), end])
                for k, start in enumerate(range(0, len(ids), size)):
                    part = ids[start:start + size]
                    for col, value in zip(rows, (n, k, start, len(part), zlib.crc32(part.tobytes()))):
                        col.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in rows[2:])], names=PIECES)

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []       # (room, bin), sorted
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        at = bisect_left(rooms, (n, -1))
        if at == len(rooms):
            bins.append([item])
            room, b = size - n, len(bins) - 1
        else:
            room, b = rooms.pop(at)
            bins[b].append(item)
            room -= n
        if room:
            insort(rooms, (room, b))
    return bins


class Steps:
    """What the open bins would give out for a longer item: nothing, one item, or two.

    One entry per bin and distinct total, in flat arrays, so that all partners of an item are weighed
    in one pass. A bin that changes is entered anew at the end; its former entries no longer fit anything.
    """

    def __init__(self, bins: list[list[int]], fill: list[int], lengths: np.ndarray, size: int):
        self.bins, self.fill, self.lengths, self.size = bins, fill, lengths, size
        self.used, self.place = 0, {}
        self.columns = np.zeros((6, 1024), np.int64)      # total out, room, fill, bin, item, other item
        for b in range(len(bins)):
            self.enter(b)

    def _options(self, b: int) -> np.ndarray:
        """(total out, item, other item) of a bin, each total once; -1 stands for no item."""
        items = np.array(self.bins[b], np.int64)
        own = self.lengths[items]
        left, right = np.triu_indices(len(items), 1)
        none = np.full(len(items), -1)
        total = np.concatenate([[0], own, own[left] + own[right]])
        first = np.concatenate([[-1], items, items[left]])
        other = np.concatenate([[-1], none, items[right]])
        totals, at = np.unique(total, return_index=True)    # the first of equals: fewer items move
        return np.stack([totals, first[at], other[at]])

    def enter(self, b: int) -> None:
        """Enter bin ``b`` as it is now. Full and empty bins give nothing."""
        old = self.place.pop(b, None)
        if old:
            self.columns[1, slice(*old)] = 0
        room = self.size - self.fill[b]
        if not self.bins[b] or not room:
            return
        options = self._options(b)
        end = self.used + options.shape[1]
        if end > self.columns.shape[1]:
            live = self.columns[:, :self.used][:, self.columns[1, :self.used] > 0]
            self.columns = np.zeros((6, 2 * (live.shape[1] + options.shape[1]) + 1024), np.int64)
            self.columns[:, :live.shape[1]] = live
            self.used, end = live.shape[1], live.shape[1] + options.shape[1]
            owners = live[3]
            cuts = np.flatnonzero(np.diff(owners, prepend=-1, append=-1))
            self.place = {int(owners[lo]): (int(lo), int(hi)) for lo, hi in zip(cuts, cuts[1:])}
        new = self.columns[:, self.used:end]
        new[0], new[1], new[2], new[3], new[4], new[5] = options[0], room, self.fill[b], b, options[1], options[2]
        self.place[b] = (self.used, end)
        self.used = end

    def best(self, donor: int) -> tuple[int, int, list[int], int] | None:
        """The step that takes an item out of ``donor`` and raises the squared fill most:
        (item, taker, items that come back, gain of the taker)."""
        total, room, fill, owner = self.columns[:4, :self.used]
        giving, found, most = self.fill[donor], None, 0
        for item in sorted(self.bins[donor], key=lambda i: -self.lengths[i]):
            gain = int(self.lengths[item]) - total
            # (f + g)^2 + (d - g)^2 - f^2 - d^2, halved
            raised = gain * (fill - giving + gain)
            raised[(gain <= 0) | (gain > room) | (owner == donor)] = 0
            at = int(raised.argmax()) if len(raised) else 0
            if len(raised) and raised[at] > most:
                most = int(raised[at])
                out = [int(i) for i in self.columns[4:, at] if i >= 0]
                found = item, int(owner[at]), out, int(gain[at])
        return found


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Swap and move items between underfull bins until no step raises the squared fill.

    A step makes a bin A fuller from a bin B: by moving an item of B into A, by exchanging one item
    of A for a longer one of B, or two items of A for one of B that is longer than both together.
    The emptiest bins give first, each the step that raises the sum of squared fills most, as
    long as there is one. Every step raises that sum, so the search ends; bins that lose their last
    item are gone. Full bins take no part. An item is weighed against all open bins in one
    pass over arrays of at most ``size`` totals a bin.
    """
    fill = [int(lengths[b].sum()) for b in bins]
    steps = Steps(bins, fill, lengths, size)
    changed = True
    while changed:
        changed = False
        for donor in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < size), key=lambda b: fill[b]):
            while bins[donor] and fill[donor] < size and (step := steps.best(donor)):
                item, taker, out, gain = step
                bins[donor].remove(item)
                bins[donor].extend(out)
                bins[taker] = [i for i in bins[taker] if i not in out] + [item]
                fill[taker] += gain
                fill[donor] -= gain
                steps.enter(taker)
                steps.enter(donor)
                changed = True
    return [b for b in bins if b]


def pack_group(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every item."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for b, items in enumerate(local_search(best_fit(lengths, size), lengths, size)):
        at = 0
        for item in items:
            where[item], offset[item] = b, at
            at += int(lengths[item])
    return where, offset


def pack(pieces: DataFrame, size: int = 4096, group_rows: int = 8_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of at most ``size``.

    Pieces that fill a sequence are one each, without a search or a shuffle. The others are
    dealt by a hash of their key and place into groups of about ``group_rows``, so that repeated
    rows spread like all others. Nothing but the number of pieces reaches the driver.
    """
    pieces = stored(pieces, "pieces")
    groups = max(1, -(-pieces.filter(F.col("length") < size).count() // group_rows))
    names = pieces.columns
    dealt = (pieces.withColumn("_place", F.monotonically_increasing_id()).filter(F.col("length") < size)
             .withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_place"), F.lit(groups)))
             .drop("_place"))
    full = (pieces.withColumn("sequence_id", F.lit(groups << 32) + F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")).filter(F.col("length") >= size))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        group = int(frame["_group"].iloc[0])
        where, offset = pack_group(frame["length"].to_numpy(), size)
        return frame[names].assign(sequence_id=group * (1 << 32) + where, offset=offset)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("_group").applyInPandas(run, f"{kinds}, sequence_id long, offset long").union(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 4096,
                   **columns: str) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place in a sequence.

    Every row of ``docs`` is packed, repeated rows as often as they stand there. Null and
    empty texts are one end id. An empty table gives no rows.
    """
    return pack(token_pieces(docs, tokenizer_path, size, **columns), size)


def lower_bound(lengths: Iterator[int], size: int) -> int:
    """No packing needs fewer sequences than the tokens fill."""
    return -(-sum(lengths) // size)
