"""Benchmark decontamination by CGK embeddings, bit sampling and exact edit distance.

A CGK walk writes a word sequence into a longer one: at every step it copies the word it
stands on and, by a random bit of step and word, stays or moves on. Two sequences few
edits apart soon walk in step again, so edit distance becomes Hamming distance. Items and
item-sized windows of documents are embedded by several walks; a table samples a few steps
of one walk, and a window is a candidate for the items that agree with it in all sampled
steps of some table. Walks of long items drift further apart, so steps and tables are chosen
for every item length by trials at the full number of edits, of substitutions, deletions,
insertions and all three mixed. Candidates are verified by
exact edit distance, in words, against the best stretch of the document around the window.

Windows are not embedded where they cannot match: an item of n words with at most k edits
keeps a run of (n - k) / (k + 1) words or more, so only windows placed by a shared run of
that many words (three at most) are looked at. This leaves out no match.

Items are taken in blocks of bounded size that are sent to the executors; documents are
read where they lie, once per block of items.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import pieces_of, words_of

SIMILARITY = 0.8
WALKS = 4
TABLES = 48             # at least
MOST_TABLES = 192
SAMPLED = 3             # steps a table samples, at most
RECALL = 0.99           # share of trials that is found, for every kind of edits
TRIALS = 128            # of every kind
LONGEST = 1000          # longer items are not sampled: all their windows are candidates
ITEM_CHARS = 4_000_000      # a block of items
CELLS = 4_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
GAP = 0                     # the word id of everything that no item holds


def edits_allowed(n: int, similarity: float) -> int:
    """Edits that keep 1 - edits / n at the similarity or above."""
    return int((1 - similarity) * n + 1e-9)


def spacing(edits: int) -> int:
    """Steps between windows: more than one only where far more edits are allowed anyway."""
    return max(1, edits // 8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def walk_bits(block: int, vocabulary: int, seed: int) -> np.ndarray:
    """Random bits of the steps 64 * block to 64 * block + 63, one number per word.

    Words are numbered from -1; entry w + 1 belongs to word w.
    """
    with np.errstate(over="ignore"):
        return _mix(np.arange(vocabulary + 2, dtype=np.uint64) ^ _mix(np.array([block * 1000 + seed + 1], np.uint64)))


def embed(words: np.ndarray, starts: np.ndarray, n: int | np.ndarray, vocabulary: int, seed: int,
          wanted: np.ndarray) -> np.ndarray:
    """Words written at the ``wanted`` steps (steps x walks) of walks over words[start:start + n].

    Behind the last word a walk writes -1, as it does on a gap between texts.
    """
    stops = starts + n
    words = np.concatenate([words, np.full(int(np.max(n, initial=0)) + 1, -1, words.dtype)])
    at = starts.copy()
    out = np.empty((len(wanted), len(starts)), np.int64)
    place = {int(w): k for k, w in enumerate(wanted)}
    for step in range(int(wanted[-1]) + 1 if len(wanted) else 0):
        if step % 64 == 0:
            bits = walk_bits(step // 64, vocabulary, seed).view(np.int64)
        word = words[np.minimum(at, stops)]
        if step in place:
            out[place[step]] = np.where(at < stops, word, -1)
        at += (bits[word + 1] >> (step % 64)) & 1
    return out


def draw_samples(n: int, sampled: int, tables: int) -> list[list[np.ndarray]]:
    """Per walk, the steps that its tables sample for items of n words."""
    rng = np.random.default_rng(n)
    # a walk moves on every other step; later steps write little but the end
    return [[np.sort(rng.choice(2 * n, min(sampled, 2 * n), replace=False)) for _ in range(tables // WALKS)]
            for _ in range(WALKS)]


def edited(words: list[int], edits: int, kind: int, fresh: int, rng: np.random.Generator) -> list[int]:
    """So many edits at random places: substitutions (0), deletions (1), insertions (2) or mixed (3)."""
    out = list(words)
    kinds = rng.integers(0, 3, edits) if kind == 3 else [kind] * edits
    for k, (how, at) in enumerate(zip(kinds, np.sort(rng.choice(len(words), edits, replace=False))[::-1])):
        out[at:at + 1] = [[fresh + k], [], [fresh + k, out[at]]][how]
    return out


@lru_cache(maxsize=None)
def _trials(n: int, similarity: float, sampled: int) -> int | None:
    """Tables that find RECALL of the trials of every kind; None if MOST_TABLES do not."""
    k = edits_allowed(n, similarity)
    step, rng = spacing(k), np.random.default_rng(n)
    items = np.arange(4 * TRIALS)[:, None] * (n + k) + np.arange(1, n + 1)
    offsets = np.arange(-(-(-k // step)), -(-k // step) + 1) * step
    words, starts = [], []
    for trial, item in enumerate(items):
        lead = k + 2 * step
        starts.append(len(words) + lead + offsets - rng.integers(step))
        words += [GAP] * lead + edited(item.tolist(), k, trial % 4, int(item[-1]) + 1, rng) + [GAP] * (n + 2 * k)
    vocabulary = int(items[-1, -1]) + k
    found = []
    for walk, samples in enumerate(draw_samples(n, sampled, MOST_TABLES)):
        wanted = np.unique(np.concatenate(samples))
        own = embed(items.ravel(), np.arange(len(items)) * n, n, vocabulary, walk, wanted)
        met = embed(np.array(words), np.concatenate(starts), n, vocabulary, walk, wanted)
        same = met.reshape(len(wanted), len(items), len(offsets)) == own[:, :, None]
        found.append([same[np.searchsorted(wanted, s)].all(axis=0).any(axis=1) for s in samples])
    # walk by walk, as many tables of each
    met = np.logical_or.accumulate(np.array(found).any(axis=0), axis=0)
    enough = (met.reshape(len(met), TRIALS, 4).mean(axis=1) >= RECALL).all(axis=1)
    return (int(enough.argmax()) + 1) * WALKS if enough.any() else None


def plan_length(n: int, similarity: float) -> tuple[int, int]:
    """(sampled steps, tables) for items of n words; no steps: every window is a candidate.

    Lengths are rounded up for the trials, since longer items are found less often.
    """
    if edits_allowed(n, similarity) == 0:
        return SAMPLED, TABLES
    unit = 5 * max(1, n // 50)
    like = -(-n // unit) * unit
    if n <= LONGEST:
        for sampled in range(SAMPLED, 0, -1):
            tables = _trials(like, similarity, sampled)
            if tables is not None:
                return sampled, max(TABLES, tables)
    return 0, WALKS


def stretch_distance(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest edit distance of the item to a stretch of each region, and where it ends."""
    width = regions.shape[1]
    columns = np.arange(width + 1)
    row = np.zeros((len(regions), width + 1), np.int32)
    for i, word in enumerate(item, 1):
        after = np.empty_like(row)
        after[:, 0] = i
        after[:, 1:] = np.minimum(row[:, :-1] + (regions != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(after - columns, axis=1) + columns      # insertions
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end


def matching(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all keys[i] == sorted_keys[j]."""
    low, high = np.searchsorted(sorted_keys, keys), np.searchsorted(sorted_keys, keys, side="right")
    counts = high - low
    of = np.repeat(np.arange(len(keys)), counts)
    return of, np.repeat(low, counts) + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


class ItemIndex:
    """Items of one block: word ids, shared runs, and sampled embeddings by length."""

    def __init__(self, items: list[tuple[object, str | None]], similarity: float,
                 plans: dict[int, tuple[int, int]] | None = None):
        self.similarity = similarity
        self.plans = plans or {}
        self.ids: dict[bytes, int] = {}
        by_words: dict[tuple, list] = defaultdict(list)
        for item_id, text in items:
            words = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text))
            if words:
                by_words[words].append(item_id)
        self.items = [np.array(w, np.int32) for w in by_words]
        self.item_ids = list(by_words.values())
        self.run_of: dict[int, list] = {}       # run length -> sorted codes, item, place
        self.tables: dict[int, tuple] = {}      # item length -> walks and tables
        runs: dict[int, list] = defaultdict(list)
        for t, item in enumerate(self.items):
            n, k = len(item), edits_allowed(len(item), similarity)
            size = min(3, -(-(n - k) // (k + 1)))
            own = {}        # of equal runs near each other in an item, one places the windows
            for q in range(n - size + 1):
                own.setdefault((self.code(item[q:q + size]), q // spacing(k)), q)
            runs[size] += [(code, t, q) for (code, _), q in own.items()]
        for size, found in runs.items():
            found.sort()
            codes, ts, qs = (np.array(c, np.int64) for c in zip(*found))
            # a bitmap by hashed code discards most places before the exact search
            bitmap = np.zeros(1 << 20, bool)
            bitmap[self._slot(codes)] = True
            self.run_of[size] = [bitmap, codes, ts, qs]
        lengths: dict[int, list] = defaultdict(list)
        for t, item in enumerate(self.items):
            lengths[len(item)].append(t)
        # gaps in front of every text, for windows that begin before it
        self.lead = 0
        for n, ts in lengths.items():
            sampled, tables = self.plans.get(n) or plan_length(n, similarity)
            if sampled:
                k = edits_allowed(n, similarity)
                self.lead = max(self.lead, k + 2 * spacing(k))
            self.tables[n] = self._tables(n, ts, sampled, tables)

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes.astype(np.uint64) * _MIX) >> np.uint64(44)).astype(np.int64)

    def code(self, words) -> int:
        base, value = len(self.ids) + 1, 0
        for w in words:
            value = value * base + int(w)
        return value

    def _tables(self, n: int, ts: list[int], sampled: int, tables: int):
        """Per walk: the wanted steps, and per table the sampled steps, sorted keys and items."""
        words = np.concatenate([self.items[t] for t in ts])
        starts = np.arange(len(ts), dtype=np.int64) * n
        walks = []
        for walk, samples in enumerate(draw_samples(n, sampled, tables)):
            wanted = np.unique(np.concatenate(samples))
            written = embed(words, starts, n, len(self.ids), walk, wanted)
            tables = []
            for sample in samples:
                columns = np.searchsorted(wanted, sample)
                keys = self._keys(written[columns])
                order = np.argsort(keys, kind="stable")
                tables.append((columns, keys[order], np.array(ts, np.int64)[order]))
            walks.append((wanted, tables))
        return walks

    def _keys(self, sampled: np.ndarray) -> np.ndarray:
        keys = np.zeros(sampled.shape[1], np.int64)
        for words in sampled:
            keys = keys * (len(self.ids) + 2) + words + 1
        return keys

    def word_ids(self, words: list[bytes]) -> list[int]:
        get = self.ids.get
        return [get(w, GAP) for w in words]

    def windows(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of windows by item length, placed by runs shared with an item."""
        base = len(self.ids) + 1
        found = defaultdict(list)
        for size, (bitmap, codes, ts, qs) in self.run_of.items():
            held = len(words) - size + 1
            if held < 1:
                continue
            code = np.zeros(held, np.int64)
            whole = np.ones(held, bool)
            for q in range(size):
                part = words[q:q + held]
                code = code * base + part
                whole &= part > GAP
            at = np.flatnonzero(whole)
            at = at[bitmap[self._slot(code[at])]]
            of, hit = matching(codes, code[at])
            place = at[of]
            sizes = np.array([len(self.items[t]) for t in ts], np.int64)[hit]
            for n in np.unique(sizes):
                own = sizes == n
                found[int(n)].append(place[own] - qs[hit][own])
        out = {}
        for n, parts in found.items():
            k = edits_allowed(n, self.similarity)
            step = spacing(k)
            grid = np.unique(np.concatenate(parts) // step)[:, None] + np.arange(-(-(-k // step)), -(-k // step) + 1)
            starts = np.unique(grid) * step
            out[n] = starts[(starts >= 0) & (starts < len(words))]
        return out

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, starts) of windows that agree with the item in some table."""
        alike: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for n, starts in self.windows(words).items():
            alike[n.bit_length()].append((n, starts))       # embedded together
        found = [np.zeros((0, 2), np.int64)]
        for group in alike.values():
            starts = np.concatenate([s for _, s in group])
            sizes = np.repeat([n for n, _ in group], [len(s) for _, s in group])
            own = []
            for walk in range(WALKS):
                steps = np.unique(np.concatenate([self.tables[n][walk][0] for n, _ in group]))
                written = embed(words, starts, sizes, len(self.ids), walk, steps)
                at = 0
                for n, part in group:
                    wanted, tables = self.tables[n][walk]
                    own_steps = written[np.searchsorted(steps, wanted), at:at + len(part)]
                    at += len(part)
                    for columns, sorted_keys, ts in tables:
                        of, hit = matching(sorted_keys, self._keys(own_steps[columns]))
                        own.append(np.stack([ts[hit], part[of]], axis=1))
            found.append(np.unique(np.concatenate(own), axis=0))
        both = np.concatenate(found)
        return both[:, 0], both[:, 1]

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, edits, end) of verified candidates; -1 in ``words`` ends a text.

        Candidates of an item whose surroundings overlap are verified as one region.
        """
        gaps = np.flatnonzero(words < 0)
        by_item = defaultdict(list)
        for t, start in zip(*(c.tolist() for c in self.candidates(words))):
            by_item[t].append(start)
        out = []
        for t, starts in by_item.items():
            item = self.items[t]
            n, k = len(item), edits_allowed(len(item), self.similarity)
            starts, margin = np.sort(np.array(starts, np.int64)), k + spacing(k)
            ends = np.append(gaps, len(words))[np.searchsorted(gaps, starts)]
            opens = np.append(-1, gaps)[np.searchsorted(gaps, starts)] + 1
            low, high = np.maximum(starts - margin, opens), np.minimum(starts + n + margin, ends)
            fresh = np.r_[True, low[1:] > np.maximum.accumulate(high)[:-1]]
            low, high = low[fresh], np.maximum.reduceat(high, np.flatnonzero(fresh))
            order = np.argsort(high - low, kind="stable")
            low, high = low[order], high[order]
            at = 0
            while at < len(low):    # regions of like width, CELLS words at most
                width = int(high[at] - low[at])
                some = at + max(1, CELLS // max(1, 2 * width))
                some = min(some, int(np.searchsorted(high - low, 2 * width, side="right")), len(low))
                some = max(some, at + 1)
                columns = np.arange(int((high - low)[some - 1]))
                places = low[at:some, None] + columns
                region = np.where(places < high[at:some, None], words[np.minimum(places, len(words) - 1)], -1)
                edits, end = stretch_distance(item, region)
                for first, e, stop in zip(low[at:some], edits, end):
                    if e <= k:
                        out.append((t, int(e), int(first) + int(stop)))
                at = some
        return out


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
               text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, n_words, end_word) of items found in documents.

    One row per document and item: the fewest edits, then the first place (the word after
    the stretch). Words are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased. Items and documents without words match nothing. Rows that share an id
    are one item or document. Empty tables give no rows.
    """
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    items = items.select(items[item_id].alias("item_id"), items[item_text].alias("text"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, n_words int, end_word long"
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_CHARS))
    found = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        part = _block_leaks(docs, [(r["item_id"], r["text"]) for r in own], similarity, schema, items)
        found = part if found is None else found.union(part)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "end_word", "n_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.edits", "best.n_words", "best.end_word")


def _block_leaks(docs: DataFrame, own: list, similarity: float, schema: str, items: DataFrame) -> DataFrame:
    # planned once, not in every task
    plans = {n: plan_length(n, similarity) for n in {len(words_of(text)) for _, text in own} if n}
    index = docs.sparkSession.sparkContext.broadcast((own, similarity, plans))      # at most ITEM_CHARS of text
    from pyspark.sql.pandas.types import to_arrow_type
    item_kind = to_arrow_type(items.schema["item_id"].dataType)

    def run(batches):
        built = ItemIndex(*index.value)
        for batch in pieces_of(batches, chars=8_000_000):
            texts = [np.array(built.word_ids(words_of(t)), np.int32) for t in batch.column("text").to_pylist()]
            bounds = np.cumsum([0] + [built.lead + len(t) + 1 for t in texts])
            words = np.full(bounds[-1], -1, np.int32)
            for at, ids in zip(bounds, texts):
                words[at:at + built.lead] = GAP
                words[at + built.lead:at + built.lead + len(ids)] = ids
            rows = [[], [], [], [], []]
            for t, edits, end in built.matches(words):
                doc = int(np.searchsorted(bounds, end - 1, side="right")) - 1
                for item in built.item_ids[t]:
                    for col, value in zip(rows, (doc, item, edits, len(built.items[t]),
                                                end - int(bounds[doc]) - built.lead)):
                        col.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], item_kind),
                 pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int64())],
                names=["doc_id", "item_id", "edits", "n_words", "end_word"])

    return docs.mapInArrow(run, schema)
