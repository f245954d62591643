"""Evaluation numbers, all from one grouped count of (gold, predicted).

The data is aggregated once to a table no larger than labels x labels per group; every
score after that works on the small table. Undefined values are null, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replylens.functions import stats as st

OTHER = "__other__"
DIMENSIONS = ["grounded", "addresses_ask", "no_overpromise", "tone_ok", "acceptable"]


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def confusion_counts(df: DataFrame, gold: str = "gold", pred: str = "pred",
                     by: Sequence[str] = ()) -> DataFrame:
    """(gold, pred) -> n. Rows without a prediction are not graded."""
    return (df.filter(F.col(pred).isNotNull())
            .groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(_n()))


def label_domain(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Every label seen on either side."""
    return (df.select(F.explode(F.array(gold, pred)).alias("label")).distinct()
            .filter(F.col("label").isNotNull()))


def _label_array(labels: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def _cells(counts: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with its counts as an array.

    Labels outside the list are folded into one first, so the array holds at most
    (labels + 1)^2 cells. Zeros can then be added without a second look at the data.
    """
    def known(c: str) -> Column:
        return F.when(F.col(c).isin(*labels), F.col(c)).otherwise(F.lit(OTHER)).alias(c)

    folded = counts.groupBy(*by, known("gold"), known("pred")).agg(F.sum("n").alias("n"))
    return folded.groupBy(*by).agg(F.collect_list(F.struct("gold", "pred", "n")).alias("cells"))


def confusion_grid(counts: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The dense grid with zeros; predictions outside the labels go to ``__other__``."""
    zeros = F.flatten(F.transform(_label_array(labels), lambda g: F.transform(
        _label_array([*labels, OTHER]), lambda p: F.struct(
            g.alias("gold"), p.alias("pred"), F.lit(0).cast("long").alias("n")))))
    cells = _cells(counts, labels, by).select(*by, F.explode(F.concat("cells", zeros)).alias("c"))
    return (cells.select(*by, "c.*").filter(F.col("gold") != OTHER)
            .groupBy(*by, "gold", "pred").agg(F.sum("n").alias("n")))


def per_class(counts: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Tp, fp, fn, support, precision, recall, f1 for every listed label."""
    zero = F.lit(0).cast("long")

    def side(label: Column, tp: Column, fp: Column, fn: Column) -> Column:
        return F.struct(label.alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    def sides(c: Column) -> Column:
        hit = F.when(c["gold"] == c["pred"], c["n"]).otherwise(zero)
        return F.array(side(c["gold"], hit, zero, c["n"] - hit),
                       side(c["pred"], zero, c["n"] - hit, zero))

    empty = F.transform(_label_array(labels), lambda x: side(x, zero, zero, zero))
    table = (_cells(counts, labels, by)
             .select(*by, F.explode(F.concat(F.flatten(F.transform("cells", sides)), empty))
                     .alias("s")).select(*by, "s.*")
             .filter(F.col("label") != OTHER)
             .groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                        F.sum("fn").alias("fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (table.withColumns({"support": tp + fn, "precision": st.ratio(tp, tp + fp),
                               "recall": st.ratio(tp, tp + fn)})
            .withColumn("f1", st.f1(F.col("precision"), F.col("recall"))))


def averaged_f1(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plain mean over all listed labels, and support-weighted mean."""
    support = F.sum("support")
    return classes.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        st.ratio(F.sum(F.col("f1") * F.col("support")), support).alias("weighted_f1"))


def accuracy(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A10: an off-taxonomy prediction is wrong, not dropped; 0 if nothing was graded."""
    right = F.coalesce(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counts.groupBy(*by).agg(right.alias("acc_correct"), total.alias("acc_n"),
                                   st.ratio(right, total).alias("acc"))


def agreement(counts: DataFrame, by: Sequence[str] = (), a: str = "gold", b: str = "pred",
              positive=None) -> DataFrame:
    """Raw agreement, Cohen's kappa and its reading, from pair counts.

    With a ``positive`` label, also how often each rater gave it (``a_rate``, ``b_rate``).
    """
    zero = F.lit(0).cast("decimal(19,0)")
    n = F.col("n").cast("decimal(19,0)")
    margins = (counts.select(*by, F.explode(F.array(
        F.struct(F.col(a).alias("label"), n.alias("row"), zero.alias("col"),
                 F.when(F.col(a) == F.col(b), n).otherwise(zero).alias("agree")),
        F.struct(F.col(b).alias("label"), zero.alias("row"), n.alias("col"),
                 zero.alias("agree")))).alias("m")).select(*by, "m.*")
        .groupBy(*by, "label").agg(F.sum("row").cast("decimal(19,0)").alias("row"),
                                   F.sum("col").cast("decimal(19,0)").alias("col"),
                                   F.sum("agree").cast("decimal(19,0)").alias("agree")))
    total = margins.groupBy(*by).agg(
        F.coalesce(F.sum("row"), zero).cast("long").alias("n"),
        F.coalesce(F.sum("agree"), zero).cast("long").alias("agree"),
        F.sum(F.col("row") * F.col("col")).alias("_chance"),
        *([] if positive is None else [
            st.ratio(F.sum(F.when(F.col("label") == positive, F.col(c))), F.sum(c), None)
            .cast("double").alias(name) for c, name in (("row", "a_rate"), ("col", "b_rate"))]))
    k = st.kappa(F.col("n"), F.col("agree"), F.col("_chance"))
    return (total.withColumns({"raw": st.ratio(F.col("agree"), F.col("n"), None), "kappa": k})
            .withColumns({"band": st.kappa_band(F.col("kappa")),
                          "verdict": st.kappa_verdict(F.col("kappa"))}).drop("_chance"))


def binary_counts(df: DataFrame, truth: str, said: str, by: Sequence[str] = ()) -> DataFrame:
    """Tp, fp, fn, tn, precision, recall, f1; the positive class needs a person."""
    t, p = F.col(truth), F.col(said)
    table = df.filter(t.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (table.withColumns({"precision": st.ratio(tp, tp + fp),
                               "recall": st.ratio(tp, tp + fn)})
            .withColumn("f1", st.f1(F.col("precision"), F.col("recall"))))


def bias_direction(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """The 2x2 of two raters and which way the second one leans."""
    table = binary_counts(df, first, second, by).select(*by, "tp", "fn", "fp", "tn")
    return table.withColumn("leans", st.leaning(F.col("fp"), F.col("fn")))


def with_interval(df: DataFrame, successes: str, n: str) -> DataFrame:
    """Wilson bounds and their display form beside a proportion."""
    return df.withColumn("_ci", st.wilson(F.col(successes), F.col(n))).select(
        *df.columns, "_ci.point", "_ci.low", "_ci.high",
        st.interval_text(F.col(successes), F.col(n)).alias("interval"))


def long_dimensions(df: DataFrame, dims: Sequence[str] = DIMENSIONS,
                    raters: Sequence[str] = ("human", "judge")) -> DataFrame:
    """Wide verdicts (``human_grounded`` ...) as rows (dim, one column per rater)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"),
                 *[F.coalesce(F.col(f"{r}_{d}"), F.lit(False)).alias(r) for r in raters])
        for d in dims])).alias("v")).select("v.*")


def dimension_agreement(df: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Per dimension raw agreement, kappa, band and both yes rates."""
    counts = long_dimensions(df, dims).groupBy("dim", "human", "judge").agg(_n())
    table = agreement(counts, ["dim"], "human", "judge", positive=True)
    return table.withColumnsRenamed({"a_rate": "human_yes", "b_rate": "judge_yes"}).fillna(
        0.0, ["human_yes", "judge_yes"])


def dimension_pass_rates(df: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Passed / n per dimension over verdicts that carry no error."""
    return (df.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d), F.lit(False)).alias("ok"))
        for d in dims])).alias("v")).groupBy("v.dim")
        .agg(F.count_if("v.ok").alias("passed"), _n())
        .withColumn("rate", st.ratio(F.col("passed"), F.col("n"))))


def config_summary(graded: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per config.

    ``graded`` is runs joined to the answer key: config, gold, pred, should_escalate,
    escalated, is_hard, replied, input_tokens, output_tokens, latency_s, error. A score is
    null for a config that never makes that kind of decision. ``replied`` is a flag (see
    ``joins.without_texts``), so that no reply text travels through the join.
    """
    has, right = F.col("pred").isNotNull(), F.col("gold") == F.col("pred")
    hard = F.coalesce(F.col("is_hard"), F.lit(False))

    def known(c: str) -> Column:
        return F.when(F.col(c).isNull() | F.col(c).isin(*labels), F.col(c)).otherwise(F.lit(OTHER))

    # One pass over the runs; what is left has a row per config and kind of outcome.
    outcomes = graded.groupBy(
        "config", known("gold").alias("gold"), known("pred").alias("pred"),
        F.coalesce(has & right, F.lit(False)).alias("right"), hard.alias("hard"),
        F.col("should_escalate").alias("t"), F.col("escalated").alias("p")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.nullif("error", F.lit("")).isNotNull()).alias("errors"),
        F.count_if("replied").alias("replies"),
        F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
        .alias("tokens"), F.sum(F.coalesce("latency_s", F.lit(0.0))).alias("latency"))

    def total(condition: Column | None = None, of: str = "n") -> Column:
        value = F.col(of) if condition is None else F.when(condition, F.col(of))
        return F.coalesce(F.sum(value), F.lit(0))

    t, p = F.col("t"), F.col("p")
    n, acc_n, esc_n = total(), total(has), total(p.isNotNull())
    n_hard, hits = total(has & F.col("hard")), total(F.col("right"))
    tp, fp, fn = total(t & p), total(~t & p), total(t & ~p)
    table = outcomes.groupBy("config").agg(
        n.alias("n"), total(of="errors").alias("errors"), acc_n.alias("acc_n"),
        hits.alias("acc_correct"), st.ratio(hits, acc_n, None).alias("acc"),
        n_hard.alias("n_hard"),
        st.ratio(total(F.col("right") & F.col("hard")), n_hard, None).alias("acc_hard"),
        F.when(esc_n > 0, st.ratio(tp, tp + fp)).alias("esc_precision"),
        F.when(esc_n > 0, st.ratio(tp, tp + fn)).alias("esc_recall"),
        F.when(esc_n > 0, fn).alias("esc_missed"),
        st.ratio(total(~p), esc_n, None).alias("auto_rate"),
        st.ratio(total(of="replies"), n).alias("reply_rate"),
        st.ratio(F.sum("tokens"), n).alias("tokens"),
        st.ratio(F.sum("latency"), n).alias("latency"),
        F.collect_list(F.when(has, F.struct("gold", "pred", "n"))).alias("_cells"))
    f1s = _f1_of_cells(F.col("_cells"), labels)
    return (table.withColumn("_f1", F.when(F.col("acc_n") > 0, f1s))
            .select(*[c for c in table.columns if c != "_cells"], "_f1.macro_f1",
                    "_f1.weighted_f1"))


def _f1_of_cells(cells: Column, labels: Sequence[str]) -> Column:
    """Macro and weighted F1 from one small array of (gold, pred, n)."""
    def add(acc: Column, x: Column, label: Column) -> Column:
        gold, pred = x["gold"] == label, x["pred"] == label
        return F.struct(
            (acc["tp"] + F.when(gold & pred, x["n"]).otherwise(0)).alias("tp"),
            (acc["one"] + F.when(gold, x["n"]).otherwise(0)
             + F.when(pred, x["n"]).otherwise(0)).alias("one"),
            (acc["support"] + F.when(gold, x["n"]).otherwise(0)).alias("support"))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("tp"), zero.alias("one"), zero.alias("support"))
    # 2 tp / (row + column) is the harmonic mean of precision and recall.
    scores = F.transform(_label_array(labels), lambda c: F.aggregate(
        cells, start, lambda acc, x: add(acc, x, c), lambda acc: F.struct(
            st.ratio(2 * acc["tp"], acc["one"]).alias("f1"), acc["support"].alias("support"))))
    plain = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x["f1"]) / len(labels)
    weighted = F.aggregate(scores, F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("w")),
                           lambda a, x: F.struct((a["s"] + x["f1"] * x["support"]).alias("s"),
                                                 (a["w"] + x["support"]).alias("w")),
                           lambda a: st.ratio(a["s"], a["w"]))
    return F.struct(plain.alias("macro_f1"), weighted.alias("weighted_f1"))


def confused_pairs(counts: DataFrame, top: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """The most frequent wrong (gold, pred) pairs."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "gold", "pred")
    return (counts.filter(F.col("gold") != F.col("pred"))
            .withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= top).drop("_rn"))


def unstable_boundaries(counts: DataFrame, a: str = "gold", b: str = "pred",
                        by: Sequence[str] = ()) -> DataFrame:
    """How often two raters swap each unordered pair of labels."""
    return (counts.filter(F.col(a) != F.col(b))
            .groupBy(*by, F.least(a, b).alias("label_a"), F.greatest(a, b).alias("label_b"))
            .agg(F.sum("n").alias("n")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A3: count and share per value; null is a value."""
    counts = df.groupBy(column).agg(_n())
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def majority_label(df: DataFrame, label: str, default: str = "product_feedback") -> DataFrame:
    """A4: the most common label as one row; ties go to the first label by name."""
    top = (df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(_n())
           .orderBy(F.desc("n"), "label").limit(1))
    return top.agg(F.coalesce(F.max("label"), F.lit(default)).alias("label"))


def duplicate_rate(df: DataFrame, text: str) -> DataFrame:
    """Share of rows whose whole text another row also has.

    Texts are counted by digest with a map-side sum, so a text copied a billion times is
    one counter per task.
    """
    counts = df.filter(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("k")).agg(_n())
    dup = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(total.alias("rows"), dup.alias("duplicates"),
                      st.ratio(dup, total).alias("duplicate_rate"))


def sources(df: DataFrame, source: str = "escalation_source") -> DataFrame:
    """Escalations by the rule that caused them."""
    return df.filter(F.col(source).isNotNull()).groupBy(source).agg(_n())


def _steps_reached(value: Column, grid: Sequence[float]) -> Column:
    """How many grid values do not exceed ``value``; a null value passes every gate."""
    reached = sum((value >= F.lit(g)).cast("int") for g in grid)
    return F.when(value.isNull(), F.lit(len(grid))).otherwise(reached)


def threshold_what_if(cases: DataFrame, taus: Sequence[float], sigmas: Sequence[float],
                      confidence: str = "confidence", similarity: str = "top_similarity",
                      escalated: str = "escalated", expected: str = "should_escalate",
                      by: Sequence[str] = ()) -> DataFrame:
    """Routing counts for every (tau, sigma) pair of the grid.

    A case passes a gate exactly when it reached that grid step, so cases are counted once
    by (steps of confidence, steps of similarity) and the grid is filled by two running
    sums over that small table. The cases never meet the grid.
    """
    taus, sigmas = sorted(taus), sorted(sigmas)
    flagged = F.coalesce(F.col(escalated), F.lit(False))
    truth = F.coalesce(F.col(expected), F.lit(False))
    hist = cases.groupBy(
        *by, _steps_reached(F.col(confidence), taus).alias("i"),
        _steps_reached(F.col(similarity), sigmas).alias("j")).agg(
        F.count_if(~flagged & truth).alias("pass_pos"),
        F.count_if(~flagged & ~truth).alias("pass_neg"),
        F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    wide = len(sigmas) + 1
    names = ["pass_pos", "pass_neg", "pos", "neg"]
    # At most one cell per pair of steps, so a group's cells are one small array.
    zeros = F.transform(F.sequence(F.lit(0), F.lit((len(taus) + 1) * wide - 1)), lambda x: F.struct(
        F.floor(x / wide).cast("int").alias("i"), (x % wide).cast("int").alias("j"),
        *[F.lit(0).cast("long").alias(c) for c in names]))
    cells = hist.groupBy(*by).agg(F.collect_list(F.struct("i", "j", *names)).alias("cells"))
    table = (cells.select(*by, F.explode(F.concat("cells", zeros)).alias("c")).select(*by, "c.*")
             .groupBy(*by, "i", "j").agg(*[F.sum(c).alias(c) for c in names]))
    # A case passes (tau_i, sigma_j) when it reached at least step i and step j.
    along_i = Window.partitionBy(*by, "j").orderBy(F.desc("i")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    along_j = Window.partitionBy(*by, "i").orderBy(F.desc("j")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    kept = names[:2]
    # The whole grid is a few thousand rows, so its totals are one small window.
    everything = Window.partitionBy(*by)
    summed = table.select(*by, "i", "j", *[F.sum(c).over(along_i).alias(c) for c in kept],
                          *[F.sum(c).over(everything).alias(c) for c in names[2:]])
    summed = summed.select(*by, "i", "j", *[F.sum(c).over(along_j).alias(c) for c in kept], *names[2:])
    pos, neg = F.col("pos"), F.col("neg")
    grid = (summed.filter((F.col("i") > 0) & (F.col("j") > 0))
            .select(*by, F.element_at(F.array(*[F.lit(float(t)) for t in taus]), F.col("i")).alias("tau"),
                    F.element_at(F.array(*[F.lit(float(s)) for s in sigmas]), F.col("j"))
                    .alias("sigma"),
                    (pos - F.col("pass_pos")).alias("tp"), (neg - F.col("pass_neg")).alias("fp"),
                    F.col("pass_pos").alias("fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return grid.withColumns({"review": tp + fp, "recall": st.ratio(tp, tp + fn, None),
                             "precision": st.ratio(tp, tp + fp, None)})


def failures(graded: DataFrame, top: int = 25, by: str = "config",
             extra: Sequence[str] = ()) -> DataFrame:
    """Up to ``top`` wrong decisions per config, in id order, with a text preview."""
    wrong = F.when(F.col("pred").isNotNull() & (F.col("gold") != F.col("pred")), F.concat(
        F.lit("intent "), F.col("pred"), F.lit(" want "), F.col("gold")))
    missed = F.when(F.col("should_escalate") & ~F.col("escalated"), F.lit("MISSED escalation"))
    rows = graded.select(by, "id", F.explode(F.array_compact(F.array(wrong, missed))).alias("why"),
                         F.substring("text", 1, 80).alias("text"), *extra)
    w = Window.partitionBy(by).orderBy("id", "why")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
