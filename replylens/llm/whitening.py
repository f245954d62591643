"""Embedding whitening by incremental eigendecomposition.

A task keeps the spectrum of what it has read: row count, mean, eigenvalues and eigenvectors
of the scatter matrix. A further row changes the scatter by one centred rank-one matrix, and
the new eigenvalues are the roots of its secular equation; directions that the row does not
touch, and equal eigenvalues, are deflated first. Spectra of tasks are merged in a tree, each
merge being one rank-one update for every eigenvector of the other side and one for the
difference of the means. The merged eigenvectors are then refined against all rows: a
distributed pass projects every row on them, and the eigenvectors of that small covariance
(Rayleigh-Ritz) turn them into those of the rows.

A spectrum has at most dimension ** 2 numbers, which bounds what a task, a merge and
the driver hold, whatever the number of rows. Rows are shifted integers, so sums are exact and
nothing is lost to the size of the common offset.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replylens.llm.common import stored

SCALE = 64              # steps of a unit of the given components
OFFSET = 1_000_000      # added to every component
COMPONENTS = 16
FAN_IN = 8              # spectra merged by one task
LIMIT = 2.0 ** 52       # entries beyond this many steps count as this many
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z**2 / (d - x))`` as (nearest pole, distance from it).

    ``d`` must rise strictly and no ``z`` may be zero. Root i lies between d[i] and d[i + 1],
    the last one within ``sum(z**2)`` above the last pole. The distance is sought instead of
    the root, so that its difference to every pole keeps full precision. A step solves for the two
    poles around the root, fitted to value and slope, or halves the bracket.
    """
    n, square = len(d), z * z
    at, last = np.arange(n), n - 1
    gap = np.append(np.diff(d), square.sum())
    middle = 1 + (square / (d[None, :] - (d + gap / 2)[:, None])).sum(axis=1)
    beyond = middle <= 0                        # the root lies in the upper half
    pole = at + (beyond & (at < last))
    apart = d[None, :] - d[pole][:, None]       # every pole as seen from the nearest one
    low = np.where(beyond, np.where(at < last, -gap / 2, gap / 2), 0.0)
    high = np.where(beyond, np.where(at < last, 0.0, gap), gap / 2)
    x = (low + high) / 2
    under = np.tri(n, dtype=bool)               # poles at or below root i
    upper = np.minimum(at + 1, last)
    done = np.zeros(n, bool)
    for _ in range(100):
        away = apart - x[:, None]
        terms = square / away
        slopes = terms / away
        below = np.einsum("ij,ij->i", terms, under)
        above = terms.sum(axis=1) - below
        value = 1 + below + above
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        done |= np.abs(value) <= 4 * EPS * n * (1 + above - below)
        if done.all():
            break
        rise = slopes.sum(axis=1)
        first = np.einsum("ij,ij->i", slopes, under)
        left, right = away[at, at], away[at, upper]
        with np.errstate(all="ignore"):
            c = value - left * first - right * (rise - first)
            a = (left + right) * value - left * right * rise
            b = left * right * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[last] = left[last] + rise[last] * left[last] ** 2 / (value[last] - left[last] * rise[last])
        after = x + step
        after = np.where((after > low) & (after < high), after, (low + high) / 2)
        done |= np.abs(after - x) <= 4 * EPS * np.abs(x)
        x = np.where(done, x, after)
    return pole, x


@dataclass
class Spectrum:
    """Rows seen, their mean, and the scatter about it: rising eigenvalues, eigenvectors as columns."""
    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(0), np.zeros((dim, 0)))

    def add_row(self, row: np.ndarray) -> None:
        """One more row: the scatter gains a rank-one matrix about the running mean."""
        off = row - self.mean
        self.n += 1
        self.mean = self.mean + off / self.n
        if self.n > 1:
            self.add_scatter(off * np.sqrt((self.n - 1) / self.n))

    def merge(self, other: Spectrum) -> None:
        """All rows of ``other``: one rank-one update per eigenvector, one for the means' distance."""
        if not other.n:
            return
        off, both = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.add_scatter(np.sqrt(value) * vector)
        if self.n:
            self.add_scatter(off * np.sqrt(self.n / both * other.n))
        self.mean = self.mean + off * (other.n / both)
        self.n = both

    def add_scatter(self, v: np.ndarray) -> None:
        """The spectrum of scatter + v v'."""
        size = np.linalg.norm(v)
        if not size:
            return
        d, q = self.values, self.vectors
        z = q.T @ v
        if q.shape[1] < len(v):                 # the part of v in no known direction is a new one
            rest = v - q @ z
            again = q.T @ rest
            rest, z = rest - q @ again, z + again
            new = np.linalg.norm(rest)
            if new > 16 * EPS * size:
                d, q, z = np.r_[0.0, d], np.column_stack([rest / new, q]), np.r_[new, z]
        slack = 8 * EPS * (d[-1] + size * size)
        # equal eigenvalues: turn their vectors so that v lies along one of them
        q = q.copy() if (close := np.flatnonzero(np.diff(d) <= slack)).size else q
        for i in close:
            length = np.hypot(z[i], z[i + 1])
            if length:
                c, s = z[i + 1] / length, z[i] / length
                q[:, i], q[:, i + 1] = c * q[:, i] - s * q[:, i + 1], s * q[:, i] + c * q[:, i + 1]
                z[i], z[i + 1] = 0.0, length
        live = np.abs(z) * size > slack         # v does not touch the others: they stay as they are
        if live.any():
            d, q = d.copy(), (q if q is not self.vectors else q.copy())
            d[live], q[:, live] = self._solved(d[live], z[live], q[:, live])
            order = np.argsort(d, kind="stable")
            d, q = d[order], q[:, order]
        self.values, self.vectors = d, q

    @staticmethod
    def _solved(d, z, q):
        pole, x = secular_roots(d, z)
        n = len(d)
        away = (d[pole][:, None] - d[None, :]) + x[:, None]         # root j above pole i
        # the z of which these roots are exact, so that the vectors are orthogonal
        beside = np.where(np.tri(n, k=-1, dtype=bool).T, d[:, None], np.append(d[1:], 0.0)[:, None]) - d[None, :]
        beside[-1] = 1.0
        exact = np.sqrt(np.abs(np.prod(away / beside, axis=0))) * np.where(z < 0, -1.0, 1.0)
        turn = exact[None, :] / away
        turn /= np.linalg.norm(turn, axis=1)[:, None]
        return d[pole] + x, q @ turn.T


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls; the shorter ones are filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def steps(vectors: DataFrame, vector_col: str) -> F.Column:
    """The vector as whole steps; null unless every component is a finite number."""
    v = vectors[vector_col]
    usable = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    step = lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(LIMIT)), F.lit(-LIMIT)))
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(v, step).cast("array<long>"))


PART = "leaf long, n long, high array<long>, low array<long>, mean array<double>, values array<double>, vectors array<double>"


def _row(leaf: int, spectrum: Spectrum, sums: list[int]) -> list:
    return [leaf, spectrum.n, [s >> 32 for s in sums], [s & 0xFFFFFFFF for s in sums], spectrum.mean.tolist(),
            spectrum.values.tolist(), spectrum.vectors.ravel().tolist()]


def _read(row) -> tuple[Spectrum, list[int]]:
    mean = np.asarray(row["mean"], float)
    return (Spectrum(int(row["n"]), mean, np.asarray(row["values"], float),
                     np.asarray(row["vectors"], float).reshape(len(mean), -1)),
            [(int(h) << 32) + int(low) for h, low in zip(row["high"], row["low"])])


def _fold(parts: DataFrame, combine) -> DataFrame:
    """Rows numbered by ``leaf`` combined in a tree, ``FAN_IN`` of them by one task, to one row."""
    import pandas as pd
    parts = stored(parts, "parts")
    while (most := parts.agg(F.max("leaf")).first()[0] or 0) > 0:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            rows = group.sort_values("leaf").to_dict("records")
            return pd.DataFrame([combine(int(rows[0]["leaf"]) // FAN_IN, rows)], columns=list(group.columns))

        parts = stored(parts.groupBy(F.floor(F.col("leaf") / FAN_IN)).applyInPandas(run, parts.schema), f"parts{most}")
    return parts


def fit_spectrum(fit: DataFrame, dim: int) -> tuple[Spectrum, list[int]] | None:
    """Spectrum and exact sums of the rows of ``fit`` (column ``y``); None if there are none."""
    def run(batches):
        from pyspark import TaskContext
        spectrum, sums = Spectrum.empty(dim), [0] * dim
        for batch in batches:
            rows = _matrix(batch.column("y"), dim)
            # halves are summed apart, so that no sum leaves the range
            sums = [s + (int(h) << 26) + int(low) for s, h, low in zip(sums, (rows >> 26).sum(axis=0), (rows & 0x3FFFFFF).sum(axis=0))]
            for row in rows.astype(float):
                spectrum.add_row(row)
        if spectrum.n:
            columns = zip(_row(TaskContext.get().partitionId(), spectrum, sums))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    arrow = pa.schema([("leaf", pa.int64()), ("n", pa.int64()), ("high", longs), ("low", longs),
                       ("mean", doubles), ("values", doubles), ("vectors", doubles)])

    def combine(leaf, rows):
        whole, sums = _read(rows[0])
        for row in rows[1:]:
            other, more = _read(row)
            whole.merge(other)
            sums = [a + b for a, b in zip(sums, more)]
        return _row(leaf, whole, sums)

    found = _fold(fit.mapInArrow(run, PART), combine).first()       # dim ** 2 numbers
    return _read(found) if found else None


@dataclass
class Centre:
    """The exact mean, as a whole part and a rest below one."""
    n: int
    sums: list[int]
    whole: np.ndarray = field(init=False)
    rest: np.ndarray = field(init=False)

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])

    def off(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.whole) - self.rest

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * row - sum) ** 2, exact; null if a long cannot hold it."""
        rest = [s - int(w) * self.n for s, w in zip(self.sums, self.whole)]
        off = rows - self.whole
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * max(1, rows.shape[1]) < 1 << 62:
            far = off * self.n - np.array(rest, np.int64)
            return (far * far).sum(axis=1).tolist()
        exact = [sum((int(o) * self.n - r) ** 2 for o, r in zip(row, rest)) for row in off]
        return [e if e < 1 << 63 else None for e in exact]


def projected_scatter(fit: DataFrame, dim: int, centre: Centre, basis: np.ndarray) -> np.ndarray:
    """Sum over the rows of p p', p being the centred row in ``basis``: one distributed pass."""
    width = basis.shape[1]
    shared = fit.sparkSession.sparkContext.broadcast((centre, basis))       # dim ** 2 numbers at most

    def run(batches):
        from pyspark import TaskContext
        own, to = shared.value
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            p = own.off(_matrix(batch.column("y"), dim)) @ to
            total, seen = total + p.T @ p, True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([total.ravel().tolist()], pa.list_(pa.float64()))],
                                             names=["leaf", "total"])

    found = _fold(fit.mapInArrow(run, "leaf long, total array<double>"),
                  lambda leaf, rows: [leaf, sum(np.asarray(r["total"], float) for r in rows).tolist()]).first()
    return np.array(found["total"]).reshape(width, width)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component.

    Rows whose vector is null or holds null or non-finite components are left out. The others
    become whole steps, ``floor(64 * c) + 1000000``; an entry beyond 2 ** 52 steps counts as that many, and
    shorter vectors are filled with zeros. The fit list holds each distinct vector once; ``n`` is its
    length, ``deviation`` the exact squared distance of n times the vector from the sums (null
    where a long cannot hold it), ``whitened`` the centred vector on the component over its
    standard deviation, ``explained`` the component's share of the variance, ``identity_error`` the
    largest entry of the whitened fit list's covariance minus the identity, measured in a pass
    of its own. Directions without variance are no components, so one vector alone, like an empty
    table, gives no rows. Repeated rows and null ids give results each. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].alias("vec_id"), steps(vectors, vector_col).alias("y")).filter("y is not null")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    dim = rows.agg(F.max(F.size("y"))).first()[0] or 0
    filled = F.concat("y", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("y")))
    fit = stored(rows.select(filled.alias("y")).distinct(), "fit")
    known = fit_spectrum(fit, dim) if dim else None
    if known is None or known[0].n < 2:
        return spark.createDataFrame([], schema)
    spectrum, sums = known
    centre = Centre(spectrum.n, sums)
    values, turn = np.linalg.eigh(projected_scatter(fit, dim, centre, spectrum.vectors) / centre.n)
    order = np.argsort(values)[::-1]
    values, axes = values[order], (spectrum.vectors @ turn)[:, order]
    kept = min(components, int((values > 64 * dim * EPS * values[0]).sum()))
    explained = (values[:kept] / values.sum()).tolist()
    scaled = axes[:, :kept] / np.sqrt(values[:kept])
    error = float(np.abs(projected_scatter(fit, dim, centre, scaled) / centre.n - np.eye(kept)).max())
    shared = spark.sparkContext.broadcast((centre, scaled))

    def run(batches):
        own, to = shared.value
        for batch in batches:
            y = _matrix(batch.column("y"), dim)
            whitened = own.off(y) @ to
            each = np.repeat(np.arange(len(y)), kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(y))),
                 pa.array(np.full(len(each), own.n)), pa.array(own.deviations(y), pa.int64()).take(pa.array(each)),
                 pa.array(whitened.ravel()), pa.array(explained * len(y), pa.float64()), pa.array(np.full(len(each), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
