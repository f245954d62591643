"""Quality by weak supervision: rules vote or abstain, their accuracies are estimated, not set.

One pass measures every text. Each rule looks at a few of these measures and says good,
junk or nothing. How votes fall together is counted over all documents, one count per
pattern of votes; there are at most 3 ** (number of rules) patterns, however many documents. On
those counts expectation-maximisation fits the share of good documents and, for every rule, how
often it says what of good and of junk documents. The posterior probability of a pattern then
replaces the demand that all rules pass.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import pieces_of, stored

WINDOW = 8              # words of the windows that are looked for twice
MIN_WORDS = 20
REPEATED = 0.30         # largest share of words in repeated windows
# Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

# Kinds of bytes, one row each: parts of words, symbols, capitals, small letters, letters, odd
# bytes (no letter and no mark of running text), and all but continuations of a character.
_B = np.arange(256)
_BLANK = np.isin(_B, np.frombuffer(b" \t\n\v\f\r", np.uint8))
_SYMBOL = np.isin(_B, np.frombuffer(SYMBOLS, np.uint8))
_UPPER = (_B >= 65) & (_B <= 90)
_LOWER = (_B >= 97) & (_B <= 122)
_LETTER = _UPPER | _LOWER | (_B >= 128)
_END = np.isin(_B, np.frombuffer(b".!?", np.uint8))
_ODD = ~(_LETTER | _BLANK | np.isin(_B, np.frombuffer(b".,;:!?\"'()-", np.uint8)))
_CHAR = ((_B & 0xC0) != 0x80) & ~_BLANK
_STEP = np.uint64(0x9E3779B97F4A7C15)       # odd, so that powers of it never vanish
MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lower", "n_plain_words", "n_marks",
            "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, its first place included.

    Windows are told apart by a rolling hash; those whose hash repeats are compared word by word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * _STEP + hashes[k:k + n]
    ordered = np.sort(rolled)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return 0
    places = np.flatnonzero(again[np.minimum(np.searchsorted(again, rolled), len(again) - 1)] == rolled)
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    wide = ids[places[:, None] + np.arange(window)]
    order = np.lexsort((*wide.T,))
    wide = wide[order]
    same = (wide[1:] == wide[:-1]).all(axis=1)
    starts = places[order[np.r_[False, same] | np.r_[same, False]]]
    covered = np.zeros(len(words) + 1, np.int64)
    covered[starts] += 1
    np.subtract.at(covered, starts + window, 1)
    return int((np.cumsum(covered) > 0).sum())


def measure(texts: list[bytes]) -> np.ndarray:
    """One row of ``MEASURES`` per text in UTF-8.

    ``n_plain_words`` hold a letter and nothing but letters, digits left out, and the marks of
    running text, none of ``!`` and ``?`` twice in a row; ``n_marks`` words end in ``.``, ``!`` or
    ``?``; ``n_echo_words`` equal the word before them. Lines are those with a word.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)       # a text ends in a blank
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    bounds = np.r_[0, ends]

    def by_text(flags, at=None):
        """Flags that are set, by text; ``at``: the places they stand for."""
        places = np.flatnonzero(flags) if at is None else at[flags]
        return np.diff(np.searchsorted(places, bounds))

    blank = _BLANK[data]
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    lasts = np.flatnonzero(~blank & np.r_[blank[1:], True])
    odd = _ODD[data]
    odd[1:] |= (data[1:] == data[:-1]) & ((data[1:] == 33) | (data[1:] == 63))
    plain = (np.add.reduceat(odd, starts, dtype=np.int32) == 0) & (
        np.add.reduceat(_LETTER[data], starts, dtype=np.int32) > 0) if len(starts) else np.zeros(0, bool)
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    out[:, 0] = np.diff(np.searchsorted(starts, bounds))
    for column, flags in enumerate((_CHAR, _SYMBOL, _UPPER, _LOWER), 1):
        out[:, column] = by_text(flags[data])
    out[:, 5] = by_text(plain, starts)
    out[:, 6] = by_text(_END[data[lasts]], lasts)
    for row, text in enumerate(texts):
        words = text.split()
        lines = [line for line in text.split(b"\n") if line and not line.isspace()]
        out[row, 7:] = (len(lines), len(lines) - len(set(lines)), repeated_words(words),
                        sum(map(eq, words, words[1:])))
    return out


# What each rule asks of the measures: when it says good, and when it says junk.
RULES: Mapping[str, tuple[str, str]] = {
    "symbols": ("n_words >= 10 and n_symbols = 0", "n_symbols > 0.1 * n_words"),
    "capitals": ("n_words >= 10 and n_upper <= 0.1 * (n_upper + n_lower)",
                 "n_words >= 10 and n_upper > 0.3 * (n_upper + n_lower)"),
    "echoes": ("n_words >= 10 and n_echo_words < 0.05 * n_words", "n_words >= 10 and n_echo_words > 0.2 * n_words"),
    "plain_words": ("n_words >= 10 and n_plain_words > 0.95 * n_words",
                    "n_words >= 10 and n_plain_words < 0.7 * n_words"),
    "sentences": ("n_words >= 10 and n_marks > 0.02 * n_words and n_marks < 0.2 * n_words",
                  "n_words >= 10 and n_marks > 0.35 * n_words or n_words > 100 and n_marks < 0.005 * n_words"),
    "repeats": ("false", "n_repeat_words > 0.3 * n_words"),
    "same_lines": ("false", "n_lines >= 4 and n_dup_lines > 0.3 * n_lines"),
    "word_length": ("false", "n_words >= 1 and (word_chars < 2.5 * n_words or word_chars > 12 * n_words)"),
}
SAYS = "+-0"            # good, junk, nothing: one character per rule makes a pattern


def cast_votes(measured: DataFrame, rules: Mapping[str, tuple[str, str]] = RULES) -> DataFrame:
    """``measured`` with ``votes``, a character of ``SAYS`` per rule. A rule that says both says junk."""
    said = [F.when(F.expr(junk), SAYS[1]).when(F.expr(good), SAYS[0]).otherwise(SAYS[2])
            for good, junk in rules.values()]
    return measured.withColumn("votes", F.concat(F.lit(""), *said))


@dataclass(frozen=True)
class VoteModel:
    share: float                            # of documents that are good
    says: np.ndarray                        # (good, junk) x rule x what it says
    posterior: dict[str, float]             # of every pattern seen
    rounds: int

    def accuracy(self, rule: int) -> float:
        """How often the rule is right where it says something."""
        good, junk = self.says[0, rule], self.says[1, rule]
        right = self.share * good[0] + (1 - self.share) * junk[1]
        said = right + self.share * good[1] + (1 - self.share) * junk[0]
        return float(right / said) if said else 0.5


def fit_votes(patterns: Mapping[str, int], rounds: int = 1000, tolerance: float = 1e-10) -> VoteModel:
    """Expectation-maximisation over how many documents have each pattern of votes.

    Rules are taken as independent given the class. Documents that no rule calls junk are good: nothing
    speaks against them, so a table without junk is not split in two. The others start
    from the count of votes, a junk vote weighing as much as three good ones.
    """
    names = sorted(patterns)
    counts = np.array([patterns[p] for p in names], float)
    said = np.array([[[c == s for s in SAYS] for c in p] for p in names], float)
    said = said.reshape(len(names), len(names[0]) if names else 0, len(SAYS))   # pattern x rule x what it says
    clear = said[:, :, 1].sum(axis=1) == 0
    good = np.where(clear, 1.0, 1 / (1 + np.exp(3 * said[:, :, 1].sum(axis=1) - said[:, :, 0].sum(axis=1))))
    share, says, done = 1.0, np.full((2, said.shape[1], len(SAYS)), 1 / len(SAYS)), 0
    while len(names) and done < rounds:
        done += 1
        weight = np.stack([counts * good, counts * (1 - good)])
        share = (weight[0].sum() + 1) / (counts.sum() + 2)
        says = (np.einsum("kp,pjv->kjv", weight, said) + 0.01) / (weight.sum(axis=1) + 0.03)[:, None, None]
        logs = np.log([share, 1 - share])[:, None] + np.einsum("kjv,pjv->kp", np.log(says), said)
        after = np.where(clear, 1.0, 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -700, 700))))
        moved = np.abs(after - good).max()
        good = after
        if moved < tolerance:
            break
    return VoteModel(float(share), says, dict(zip(names, good.tolist())), done)


def measure_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ``MEASURES`` of every whole text."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))

    def run(batches):
        for batch in pieces_of(batches):
            found = measure([t or b"" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found.T)],
                                             names=["doc_id", *MEASURES])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def judge_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rules: Mapping[str, tuple[str, str]] = RULES, least: float = 0.5) -> DataFrame:
    """Measures, ``votes``, ``posterior``, ``base_failed`` and ``kept`` of every row of ``docs``.

    ``base_failed``: fewer than ``MIN_WORDS`` words, or more than ``REPEATED`` of them in repeated
    windows. ``kept``: not that, and a posterior probability of quality of at least ``least``. A null or
    empty text has zeros everywhere and fails. Rows that repeat are counted and judged each
    by itself; an empty table gives no rows. Other columns are ignored.
    """
    voted = stored(cast_votes(measure_texts(docs, id_col, text_col), rules), "votes")
    seen = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()    # 3 ** len(rules) patterns at most
    model = fit_votes({r["votes"]: r["n"] for r in seen})
    known = docs.sparkSession.createDataFrame(sorted(model.posterior.items()), "votes string, posterior double")
    base_failed = ((F.col("n_words") < MIN_WORDS)
                   | (100 * F.col("n_repeat_words") > int(100 * REPEATED) * F.col("n_words")))
    return (voted.join(F.broadcast(known), "votes").withColumn("base_failed", base_failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
            .select("doc_id", *MEASURES, "votes", "posterior", "base_failed", "kept"))
