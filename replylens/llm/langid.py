"""Language identification in two steps: the family first, then the language in it.

Both steps are one-versus-one linear support vector machines on hashed character
trigrams of the whole text: one machine for every pair of families, and one for every pair
of languages within a family. They are fitted on a bounded sample of labelled rows;
prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replylens.llm.common import id_remainder, pieces_of

# Families of languages that resemble each other.
FAMILIES: Mapping[str, str] = {
    **dict.fromkeys("en de nl sv da no nb nn is fy af lb".split(), "germanic"),
    **dict.fromkeys("fr es it pt ro ca gl oc la".split(), "romance"),
    **dict.fromkeys("ru uk be bg mk sr hr bs sl cs sk pl".split(), "slavic"),
}
UNKNOWN = "und"
BUCKETS = 4096          # trigram buckets
PER_LANGUAGE = 500      # labelled rows of a language that are learned from, at most
_LETTER = regex.compile(r"\p{L}")
# ASCII bytes that are no letters become spaces; letters were lower-cased before
_PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of damped trigram counts; None if the text has no letter."""
    if not text or not _LETTER.search(text):
        return None
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()) + b" "
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(codes) < 3:
        return np.zeros(BUCKETS, np.float32)
    grams = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
    counts = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    damped = np.sqrt(counts).astype(np.float32)
    return damped / np.linalg.norm(damped)


def fit_svm(rows: np.ndarray, signs: np.ndarray, cost: float = 10.0, rounds: int = 30,
            seed: int = 0) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by dual coordinate descent.

    The last weight is the bias. Rows of the rarer class weigh more, so that both classes
    count alike.
    """
    # rows stay in single precision; one at a time is widened
    rows = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    share = np.where(signs > 0, (signs > 0).sum(), (signs < 0).sum())
    slack = share * 2.0 / (len(signs) * 2 * cost)
    norms = np.array([(wide * wide).sum() for wide in (row.astype(np.float64) for row in rows)]) + slack
    alpha, weights = np.zeros(len(rows)), np.zeros(rows.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            row = rows[i].astype(np.float64)
            slope = signs[i] * (weights @ row) - 1 + slack[i] * alpha[i]
            after = max(alpha[i] - slope / norms[i], 0.0)
            if after != alpha[i]:
                weights += (after - alpha[i]) * signs[i] * row
                largest = max(largest, abs(after - alpha[i]))
                alpha[i] = after
        if largest < 1e-3:
            break
    return weights


@dataclass
class Votes:
    """One-versus-one machines over some classes."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray         # one row per pair; positive means the first of the pair

    @classmethod
    def fit(cls, names: list[str], rows: np.ndarray, labels: np.ndarray) -> Votes:
        pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
        fitted = []
        for i, j in pairs:
            own = (labels == names[i]) | (labels == names[j])
            fitted.append(fit_svm(rows[own], np.where(labels[own] == names[i], 1.0, -1.0)))
        return cls(names, pairs, np.array(fitted).reshape(len(pairs), rows.shape[1] + 1))

    def predict(self, row: np.ndarray) -> tuple[str, float]:
        """The class with most votes, then the largest summed margin, then the first name.

        The score is the logistic value of its smallest margin against another class.
        """
        if not self.pairs:
            return self.names[0], 1.0
        margins = self.weights[:, :-1] @ row + self.weights[:, -1]
        wins, total = np.zeros(len(self.names)), np.zeros(len(self.names))
        least = np.full(len(self.names), np.inf)
        for (i, j), m in zip(self.pairs, margins):
            wins[i if m >= 0 else j] += 1
            total[i] += m
            total[j] -= m
            least[i], least[j] = min(least[i], m), min(least[j], -m)
        best = max(range(len(self.names)), key=lambda k: (wins[k], total[k], -k))
        return self.names[best], float(1 / (1 + np.exp(-2 * least[best])))


@dataclass
class LanguageModel:
    families: Votes | None
    within: dict[str, Votes]

    def predict(self, text: str | None) -> tuple[str, float]:
        row = features(text)
        if row is None or self.families is None:
            return UNKNOWN, 0.0
        family, sure = self.families.predict(row)
        language, surer = self.within[family].predict(row)
        return language, sure * surer


def letters_only() -> LanguageModel:
    """A model for tables without labelled rows: any text with a letter has some language."""
    one = Votes(["any"], [], np.zeros((0, BUCKETS + 1)))
    return LanguageModel(one, {"any": one})


def smallest_draws(draws: DataFrame, per_language: int) -> DataFrame:
    """The ``per_language`` smallest distinct draws of every language: (lang, draw).

    Draws are counted by their first 16 bits, at most 65,536 counts a language; only those up to the
    prefix where the number is reached are numbered, about ``per_language`` a language.
    """
    draws = draws.withColumn("prefix", F.shiftright("draw", 48))
    counts = draws.groupBy("lang", "prefix").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("prefix")) - F.col("n")
    reached = (counts.withColumn("before", before).filter(F.col("before") < per_language)
               .groupBy("lang").agg(F.max("prefix").alias("last")))
    order = Window.partitionBy("lang").orderBy("draw")
    return (draws.join(F.broadcast(reached), "lang").filter(F.col("prefix") <= F.col("last"))    # one row a language
            .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select("lang", "draw"))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  modulus: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE,
                  families: Mapping[str, str] = FAMILIES) -> LanguageModel:
    """Fit on rows with a language whose crc32(id as text) mod ``modulus`` is not ``held_out``.

    At most ``per_language`` rows of a language are learned from, drawn by a hash of id
    and text; rows that share both are learned from once. They are picked by id and hash alone, so texts of other rows never move.
    Languages outside ``families`` are a family each. Texts without letters are not
    learned from. Without labelled rows the model answers ``und``.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = (rows.filter(F.col("lang").isNotNull() & (id_remainder("id", modulus) != held_out)
                        & F.col("text").rlike(r"\p{L}"))
            .withColumn("draw", F.xxhash64("id", "text")))
    picked = smallest_draws(rows.select("lang", "draw").distinct(), per_language)

    def run(batches):
        for batch in batches:
            kept = [(lang, f) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())
                    if (f := features(text)) is not None]
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in kept]), pa.array([k[1].tobytes() for k in kept], pa.binary())],
                    names=["lang", "row"])

    # the sample has a fixed number of rows per language, so broadcasting its keys is safe
    sample = (rows.join(F.broadcast(picked), ["lang", "draw"], "left_semi")
              .dropDuplicates(["lang", "draw"]).select("lang", "text")
              .mapInArrow(run, "lang string, row binary").toArrow())
    if not sample.num_rows:
        return LanguageModel(None, {})
    labels = np.array(sample.column("lang").to_pylist(), dtype=object)
    rows = [np.frombuffer(b.as_buffer(), np.float32) for b in sample.column("row")]
    order = np.lexsort((np.array([r[0] for r in rows]), labels.astype(str)))    # the same model whatever the order of rows
    labels, data = labels[order], np.stack([rows[i] for i in order])
    del sample, rows        # the fit makes copies of its own
    family = np.array([families.get(x, x) for x in labels], dtype=object)
    names = sorted(set(family))
    within = {f: Votes.fit(sorted(set(labels[family == f])), data[family == f], labels[family == f]) for f in names}
    return LanguageModel(Votes.fit(names, data, family), within)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per input row; only the text is looked at.

    Null texts and texts without a letter are ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)    # a few rows of BUCKETS weights

    def run(batches):
        for batch in pieces_of(batches):
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             modulus: int = 4, held_out: int = 2) -> DataFrame:
    """Fit on the labelled rows that are not held out, then predict every row."""
    model = fit_languages(docs, id_col, text_col, lang_col, modulus, held_out)
    found = predict_languages(docs, model, id_col, text_col)
    return found.select("doc_id", (id_remainder("doc_id", modulus) == held_out).alias("held_out"),
                        "lang_pred", "score")
