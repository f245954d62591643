"""Column arithmetic over counts: intervals, kappa, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den as a double, or ``empty`` where the denominator is zero or null."""
    return F.when(den > 0, num / den).otherwise(F.lit(empty).cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """struct(point, low, high); all null at n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = successes / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    low = F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - half))
    high = F.when(n.isNotNull(), F.least(F.lit(1.0), centre + half))
    return F.struct(p.alias("point"), low.alias("low"), high.alias("high"))


def interval_text(successes: Column, n: Column) -> Column:
    """Point and half-width in whole percent, halves to even."""
    ci = wilson(successes, n)
    return F.when(n > 0, F.concat(
        F.bround(ci["point"] * 100, 0).cast("int").cast("string"), F.lit("% +-"),
        F.bround((ci["high"] - ci["low"]) / 2 * 100, 0).cast("int").cast("string"))
    ).otherwise(F.lit("n/a"))


def kappa(n: Column, agree: Column, chance: Column) -> Column:
    """A12 from counts: n items, agreeing items, and sum over classes of row x column.

    ``chance`` is an exact decimal and the undefined cases are tested on it, so neither
    overflow nor rounding can hide them.
    """
    exact, d = n.cast("decimal(19,0)"), n.cast("double")
    p_e = chance.cast("double") / (d * d)
    return F.when((n > 0) & (chance != exact * exact), (agree / d - p_e) / (1 - p_e))


def kappa_band(k: Column) -> Column:
    """A17."""
    return (F.when(k.isNull(), "undefined").when(k <= 0.20, "slight").when(k <= 0.40, "fair")
            .when(k <= 0.60, "moderate").when(k <= 0.80, "substantial")
            .otherwise("almost perfect"))


def kappa_verdict(k: Column) -> Column:
    """A17."""
    return (F.when(k.isNull() | (k < 0.4), "weak").when(k < 0.6, "moderate")
            .otherwise("substantial"))


def leaning(false_yes: Column, false_no: Column) -> Column:
    """Which way the second rater errs."""
    return (F.when(false_yes > false_no, "generous").when(false_no > false_yes, "harsh")
            .otherwise("symmetric"))
