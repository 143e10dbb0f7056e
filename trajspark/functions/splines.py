"""Interpolating cubic splines by banded solves, as tables of polynomials that rows look up."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a table that is broadcast, or written into an expression.
BROADCAST_CELLS, INLINE_CELLS = 200_000, 20_000


def tridiagonal(lower: np.ndarray, middle: np.ndarray, upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution for one right side, or for each column of several, in linear time. lower[0] and upper[-1] don't count."""
    a, b, c, r = lower.tolist(), middle.tolist(), upper.tolist(), right.tolist() if right.ndim == 1 else list(right)
    for i in range(1, len(b)):
        f = a[i] / b[i - 1]
        b[i] -= f * c[i - 1]
        r[i] = r[i] - f * r[i - 1]
    r[-1] = r[-1] / b[-1]
    for i in range(len(b) - 2, -1, -1):
        r[i] = (r[i] - c[i] * r[i + 1]) / b[i]
    return np.array(r)


def _curvature(h: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Second derivatives at the places; the third derivative is continuous at the second place from either end."""
    n = len(h) + 1
    if n == 2:
        return np.zeros((2, *slope.shape[1:]))
    if n == 3:
        return np.repeat(2 * np.diff(slope, axis=0) / (h[0] + h[1]), 3, axis=0)
    lower, upper, middle = h[:-1].copy(), h[1:].copy(), 2 * (h[:-1] + h[1:])
    for own, other, first, second, at in ((lower, upper, h[0], h[1], 0), (upper, lower, h[-1], h[-2], -1)):
        middle[at] += first * (first + second) / second
        other[at] -= first * first / second
        own[at] = 0.0
    inner = tridiagonal(lower, middle, upper, 6 * np.diff(slope, axis=0))
    ends = [((p + q) * inner[i] - p * inner[j]) / q for p, q, i, j in ((h[0], h[1], 0, 1), (h[-1], h[-2], -1, -2))]
    return np.concatenate([ends[0][None], inner, ends[1][None]])


def _wrapped_curvature(h: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Second derivatives of a spline that wraps round; the system with corners is one without and a correction."""
    n = len(h)
    right = 6 * (slope - np.roll(slope, 1, axis=0))
    before = np.roll(h, 1)
    if n < 3:
        a = np.zeros((n, n))
        for i in range(n):
            a[i, i] += 2 * (before[i] + h[i])
            a[i, i - 1] += before[i]
            a[i, (i + 1) % n] += h[i]
        m = np.linalg.lstsq(a, right, rcond=None)[0]
        return np.concatenate([m, m[:1]])
    middle, corner = 2 * (before + h), h[-1]
    u, w = np.zeros(n), np.zeros(n)
    u[0], u[-1] = -middle[0], corner
    w[0], w[-1] = 1.0, -corner / middle[0]
    middle[0] *= 2
    middle[-1] += corner * corner / (middle[0] / 2)
    y, z = (tridiagonal(before, middle, h, r) for r in (right, u))
    m = y - np.multiply.outer(z, (w @ y) / (1 + w @ z))
    return np.concatenate([m, m[:1]])


def cubic_pieces(x: np.ndarray, y: np.ndarray, periodic: bool = False) -> np.ndarray:
    """Coefficients (intervals, 4, ...) of the spline through (x, y), lowest first, in x - start of the
    interval; y may have further axes. Two places give a line, three a parabola, one a constant."""
    if len(x) == 1:
        return np.stack([y, *[np.zeros_like(y)] * 3], axis=1)
    h = np.diff(x)
    if periodic:
        y = np.concatenate([y[:-1], y[:1]])
    wide = h.reshape(-1, *[1] * (y.ndim - 1))
    slope = np.diff(y, axis=0) / wide
    m = (_wrapped_curvature if periodic else _curvature)(h, slope)
    return np.stack([y[:-1], slope - wide * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m, axis=0) / (6 * wide)], axis=1)


class Lattice:
    """Cells of an axis: even steps between the first and the last place, or else the places' intervals.
    What lies outside belongs to the end cells."""

    def __init__(self, places: np.ndarray, cells: int):
        h = np.diff(places)
        self.low, self.step, self.of = float(places[0]), float(h.min()) if len(h) else 1.0, np.arange(max(len(h), 1))
        count = np.rint(h / self.step)
        self.starts = places[: len(self.of)]
        self.even = bool(len(h) <= 1 or count.sum() <= cells and np.allclose(h, count * self.step, rtol=1e-6))
        if self.even and len(h) > 1:
            # the mean step, as the least one's rounding would add up
            self.step = float((places[-1] - places[0]) / count.sum())
            self.of = np.repeat(self.of, count.astype(int))

    def cell(self, v: Column) -> Column:
        n = len(self.of)
        if self.even:
            return F.least(F.greatest(F.floor((v - self.low) / self.step), F.lit(0)), F.lit(n - 1)).cast("int")
        return F.size(F.filter(_numbers(self.starts[1:]), lambda s: s <= v))


def _numbers(values: np.ndarray) -> Column:
    """A constant array, as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(np.asarray(values).ravel().tolist())), "array<double>")


class PiecewisePolynomials:
    """A function of one or two positions: on each cell a polynomial (cubic in each position)."""

    def __init__(self, axes: list[np.ndarray], values: np.ndarray, periodic: bool = False, cells: int = 1_000_000):
        self.axes = [Lattice(a, cells) for a in axes]
        found = cubic_pieces(axes[0], values, periodic)
        if len(axes) == 2:
            # along the second position, each coefficient of the first is a spline again
            found = np.moveaxis(cubic_pieces(axes[1], np.moveaxis(found, 2, 0)), (2, 3), (0, 1))
            found = np.moveaxis(found, 2, 1)
        self.pieces = found

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every cell (row-major): the starts of its polynomial, and its coefficients."""
        picked = self.pieces[np.ix_(*(a.of for a in self.axes))]
        starts = np.meshgrid(*(a.starts[a.of] for a in self.axes), indexing="ij")
        return np.stack([s.ravel() for s in starts], axis=1), picked.reshape(-1, 4 ** len(self.axes))

    def cell(self, x: list[Column]) -> Column:
        at = self.axes[0].cell(x[0])
        return at if len(x) == 1 else at * len(self.axes[1].of) + self.axes[1].cell(x[1])

    @staticmethod
    def value(offsets: list[Column], coefficient, derivative: tuple[int, ...]) -> Column:
        """Horner's rule for each position; coefficient(i) is the i-th Column."""

        def along(axis: int, base: int) -> Column:
            total = F.lit(0.0)
            for p in range(3, derivative[axis] - 1, -1):
                factor = 1
                for q in range(derivative[axis]):
                    factor *= p - q
                part = coefficient(base + p) if axis + 1 == len(offsets) else along(axis + 1, 4 * (base + p))
                total = total * offsets[axis] + part * float(factor)
            return total

        return along(0, 0)

    def columns(self, x: list[Column], derivatives: list[tuple[int, ...]]) -> list[Column]:
        """Values at x as expressions, with the table as a constant of the plan."""
        starts, table = self.table()
        if len(table) > INLINE_CELLS:
            raise ValueError(f"{len(table)} cells are too many for an expression; attach the basis to a table")
        known, places, at = _numbers(table), _numbers(starts), self.cell(x)
        offsets = [v - F.get(places, at * len(x) + i) for i, v in enumerate(x)]
        return [self.value(offsets, lambda i: F.get(known, at * table.shape[1] + i), d) for d in derivatives]

    def attach(self, df: DataFrame, x: list[Column], derivatives: list[tuple[int, ...]], names: list[str]) -> DataFrame:
        """df with values at x: the cell's polynomial is looked up in a table by a join, which is a
        broadcast where the table is small."""
        starts, table = self.table()
        known = _as_table(df.sparkSession, starts, table)
        met = df.withColumn("_cell", self.cell(x)).join(F.broadcast(known) if len(table) <= BROADCAST_CELLS else known, "_cell", "left")
        offsets = [v - F.get("_starts", F.lit(i)) for i, v in enumerate(x)]
        values = [self.value(offsets, lambda i: F.get("_c", F.lit(i)), d) for d in derivatives]
        return met.withColumns(dict(zip(names, values, strict=True))).drop("_cell", "_starts", "_c")


def _as_table(spark: SparkSession, starts: np.ndarray, table: np.ndarray) -> DataFrame:
    import pyarrow as pa

    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
    return spark.createDataFrame(pa.table({"_cell": pa.array(np.arange(len(table)), pa.int32()), "_starts": lists(starts), "_c": lists(table)}))
