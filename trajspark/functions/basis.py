"""Bases of positions: fitted by one aggregate, evaluated as a Column from array x to array bk."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

KINDS: dict[str, type[Basis]] = {}


class Basis:
    """fit(df with array x) sets n_basis; column(x) is the array of basis values. Fitted once, a basis
    is reused on other data as it is."""

    dim_x: int = 1
    n_basis: int = 0

    def __init_subclass__(cls):
        KINDS[cls.__name__] = cls

    def fit(self, df: DataFrame) -> Basis:
        return self

    def column(self, x: str | Column) -> Column:
        raise NotImplementedError

    def sparse(self, x: str | Column) -> Column:
        """The elements that are not zero, as an array of (i, value)."""
        each = F.transform(self.column(x), lambda v, i: F.struct(i.cast("int").alias("i"), v.alias("value")))
        return F.filter(each, lambda e: e["value"] != 0)

    def attach(self, df: DataFrame, name: str = "bk", sparse: bool = False) -> DataFrame:
        """df with the basis values at x as the array column name."""
        return df.withColumn(name, self.sparse("x") if sparse else self.column("x"))

    def to_row(self, spark: SparkSession) -> DataFrame:
        """kind, dim_x, n_basis, params (JSON): a row to write as Parquet."""
        params = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items() if k not in ("dim_x", "n_basis")}
        return spark.range(1).select(F.lit(type(self).__name__).alias("kind"), F.lit(self.dim_x).alias("dim_x"), F.lit(self.n_basis).alias("n_basis"), F.lit(json.dumps(params)).alias("params"))

    @staticmethod
    def from_row(row) -> Basis:
        basis = KINDS[row["kind"]].__new__(KINDS[row["kind"]])
        vars(basis).update(json.loads(row["params"]), dim_x=row["dim_x"], n_basis=row["n_basis"])
        return basis


def _x(x: str | Column, i: int) -> Column:
    return F.get(x, F.lit(i))


def _products(terms: list[Column], degree: int) -> list[Column]:
    """All products with repetition of 1 to degree terms."""
    out = []
    for n in range(1, degree + 1):
        for chosen in combinations_with_replacement(terms, n):
            p = chosen[0]
            for c in chosen[1:]:
                p = p * c
            out.append(p)
    return out


def n_products(n: int, degree: int) -> int:
    return sum(math.comb(n + k - 1, k) for k in range(1, degree + 1))


class LinearBasis(Basis):
    def __init__(self, dim_x: int = 1, center: bool = False):
        self.dim_x = self.n_basis = dim_x
        self.center, self.mean = center, [0.0] * dim_x

    def fit(self, df: DataFrame) -> LinearBasis:
        if self.center:
            self.mean = list(df.agg(*[F.avg(_x("x", i)) for i in range(self.dim_x)]).first())
        return self

    def column(self, x: str | Column) -> Column:
        return F.array(*[_x(x, i) - F.lit(m) for i, m in enumerate(self.mean)])


class PolynomialBasis(Basis):
    """1, x1, x2, x1^2, x1 x2, x2^2, ... up to the degree."""

    def __init__(self, dim_x: int = 1, degree: int = 3):
        self.dim_x, self.degree = dim_x, degree
        self.n_basis = 1 + n_products(dim_x, degree)

    def column(self, x: str | Column) -> Column:
        return F.array(F.lit(1.0), *_products([_x(x, i) for i in range(self.dim_x)], self.degree))


def auto_bins(df: DataFrame, dim_x: int = 1) -> int:
    """Bins by the larger of 1 + log2 n and the Freedman-Diaconis rule; the most over the axes."""
    stats = df.agg(F.count(F.lit(1)), *[f for i in range(dim_x) for f in (F.min(_x("x", i)), F.max(_x("x", i)))]).first()
    quartiles = exact_quantiles(df, [_x("x", i) for i in range(dim_x)], [0.25, 0.75])
    n, most = stats[0], 1.0
    for i in range(dim_x):
        low, high = stats[1 + 2 * i : 3 + 2 * i]
        q1, q3 = quartiles[i]
        width = 2 * (q3 - q1) * n ** (-1 / 3)
        most = max(most, 1 + math.log2(n), int((high - low) / width + 1) if width > 0 else 1)
    return int(most)


class BinsBasis(Basis):
    """One-hot bins of each axis, by uniform, quantile or kmeans edges; values outside go to the first
    or last bin. combine: products of bins over axes up to degree dim_x."""

    def __init__(self, dim_x: int = 1, n_bins: int | str = "auto", strategy: str = "uniform", combine: bool = False):
        self.dim_x, self.n_bins, self.strategy, self.combine = dim_x, n_bins, strategy, combine
        self.edges: list[list[float]] = []

    def fit(self, df: DataFrame) -> BinsBasis:
        n = auto_bins(df, self.dim_x) if self.n_bins == "auto" else int(self.n_bins)
        ends = df.agg(*[f for i in range(self.dim_x) for f in (F.min(_x("x", i)), F.max(_x("x", i)))]).first()
        self.edges = []
        for i in range(self.dim_x):
            low, high = ends[2 * i], ends[2 * i + 1]
            if self.strategy == "uniform":
                inner = np.linspace(low, high, n + 1)[1:-1]
            elif self.strategy == "quantile":
                inner = exact_quantiles(df, [_x("x", i)], [k / n for k in range(1, n)])[0]
            elif self.strategy == "kmeans":
                from pyspark.ml.clustering import KMeans
                from pyspark.ml.functions import array_to_vector

                points = df.select(array_to_vector(F.array(_x("x", i))).alias("features"))
                centers = sorted(float(c[0]) for c in KMeans(k=n, seed=0).fit(points).clusterCenters())
                inner = [(a + b) / 2 for a, b in zip(centers, centers[1:], strict=False)]
            else:
                raise ValueError(f"unknown strategy {self.strategy}")
            # equal edges would make bins that nothing falls into
            self.edges.append([float(e) for e in dict.fromkeys(inner)])
        single = sum(len(e) + 1 for e in self.edges)
        self.n_basis = n_products(single, self.dim_x) if self.combine else single
        return self

    def index(self, x: str | Column, axis: int = 0) -> Column:
        """Bin of a value: the number of inner edges that it reaches."""
        return F.size(F.filter(numbers(self.edges[axis]), lambda e: e <= _x(x, axis)))

    def sparse(self, x: str | Column) -> Column:
        """One live bin an axis, and their products."""
        before = [sum(len(e) + 1 for e in self.edges[:a]) for a in range(self.dim_x)]
        live = F.array(*[_entry(self.index(x, a) + before[a], F.lit(1.0)) for a in range(self.dim_x)])
        return _entries(live, self.dim_x, sum(len(e) + 1 for e in self.edges), self.dim_x if self.combine else 1) if self.dim_x <= 2 or not self.combine else super().sparse(x)

    def column(self, x: str | Column) -> Column:
        if self.n_basis > INLINE and (self.dim_x <= 2 or not self.combine):
            return _filled(self.sparse(x), self.n_basis)
        terms = []
        for axis, edges in enumerate(self.edges):
            v, cuts = _x(x, axis), [None, *edges, None]
            for a, b in zip(cuts, cuts[1:], strict=False):
                inside = F.lit(True)
                if a is not None:
                    inside &= v >= a
                if b is not None:
                    inside &= v < b
                terms.append(F.when(inside, 1.0).otherwise(0.0))
        return F.array(*(_products(terms, self.dim_x) if self.combine else terms))


def spline_knots(points: np.ndarray, degree: int) -> np.ndarray:
    """Knots of the interpolating spline through points: clamped ends; inner knots at the points
    (odd degree) or half-way between them (even degree)."""
    m, half = len(points), (degree + 1) // 2
    if degree % 2:
        inner = points[half : m - half]
    else:
        inner = (points[degree // 2 : m - degree // 2 - 1] + points[degree // 2 + 1 : m - degree // 2]) / 2
    return np.r_[[points[0]] * (degree + 1), inner, [points[-1]] * (degree + 1)]


def live_splines(knots: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each interval between different knots: its start (and the last one's end), its first live
    B-spline, and the coefficients (interval, live, degree + 1), lowest first in x - start, of the
    degree + 1 splines that are not zero there. Each spline comes from the two of a lower degree below it."""
    place = np.flatnonzero(np.diff(knots) > 0)
    place = place[(place >= degree) & (place < len(knots) - degree - 1)]
    start, width = knots[place], knots[place + 1] - knots[place]
    live = np.zeros((len(place), degree + 1, degree + 1))
    live[:, 0, 0] = 1
    for k in range(1, degree + 1):
        below, live = live, np.zeros_like(live)
        for j in range(k):  # the j-th live spline of degree k - 1 gives parts of the j-th and the next one
            low, high = knots[place - k + 1 + j], knots[place + 1 + j]
            share = below[:, j] / (high - low)[:, None]
            rising = (start - low)[:, None] * share
            falling = (high - start)[:, None] * share
            rising[:, 1:] += share[:, :-1]
            falling[:, 1:] -= share[:, :-1]
            live[:, j] += falling
            live[:, j + 1] += rising
    return np.r_[start, start[-1] + width[-1]], place - degree, live


def spline_polynomials(knots: np.ndarray, coefs: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Break points, and for each interval between them the coefficients (lowest first) of each
    column's polynomial in x - start."""
    breaks, first, live = live_splines(knots, degree)
    return breaks, np.einsum("ilp,ilc->ipc", live, coefs[first[:, None] + np.arange(degree + 1)])


def design(knots: np.ndarray, x: np.ndarray, degree: int, inside: float | None = None) -> np.ndarray:
    """Values of all B-splines at x by the Cox-de Boor recursion. With `inside`, the polynomials of
    the interval that holds it are used at every x; else those of x's own, the ends' outside."""
    n = len(knots) - degree - 1
    place = np.clip(np.searchsorted(knots, x if inside is None else np.full(len(x), inside), side="right") - 1, degree, n - 1)
    b = np.zeros((len(x), len(knots) - 1))
    b[np.arange(len(x)), place] = 1
    for k in range(1, degree + 1):
        new = np.zeros((len(x), len(knots) - 1 - k))
        for i in range(len(knots) - 1 - k):
            left, right = knots[i + k] - knots[i], knots[i + k + 1] - knots[i + 1]
            if left > 0:
                new[:, i] += (x - knots[i]) / left * b[:, i]
            if right > 0:
                new[:, i] += (knots[i + k + 1] - x) / right * b[:, i + 1]
        b = new
    return b


def interval(v: Column, breaks) -> Column:
    """Number of the interval between breaks that holds v; the first and last go on outside. Even
    breaks need no search."""
    n, step = len(breaks) - 1, (breaks[-1] - breaks[0]) / (len(breaks) - 1)
    if n > 64 and np.allclose(np.diff(breaks), step, rtol=1e-9):
        return F.least(F.greatest(F.floor((v - float(breaks[0])) / float(step)), F.lit(0)), F.lit(n - 1)).cast("int")
    return F.size(F.filter(numbers(breaks[1:-1]), lambda e: e <= v)) if n > 1 else F.lit(0)


def piecewise(v: Column, breaks: np.ndarray, polynomials: np.ndarray, derivative: int = 0) -> list[Column]:
    """A Column of each polynomial column at v: the interval is looked up, then Horner's rule. Outside,
    the end intervals' polynomials go on."""
    at = interval(v, breaks)
    d = v - F.get(F.array(*[F.lit(float(b)) for b in breaks[:-1]]), at)
    degree, out = polynomials.shape[1] - 1, []
    for c in range(polynomials.shape[2]):
        value = F.lit(0.0)
        for p in range(degree, derivative - 1, -1):
            factor = math.perm(p, derivative)
            value = value * d + F.get(F.array(*[F.lit(float(q[p, c] * factor)) for q in polynomials]), at)
        out.append(value)
    return out


#: Elements of a basis up to which each has an expression of its own.
INLINE = 64


def numbers(values) -> Column:
    """A constant array, as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(np.asarray(values, float).ravel().tolist())), "array<double>")


def _rank(i: Column, j: Column, n: int) -> Column:
    """Place of the product of terms i and j of n, as _products has it."""
    low, high = F.least(i, j), F.greatest(i, j)
    return F.lit(n) + low * n - F.shiftright(low * (low - 1), 1) + high - low


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is made once, however often fn has it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _entry(i: Column, value: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), value.alias("value"))


def _entries(live: Column, count: int, n: int, degree: int) -> Column:
    """(i, value) of `count` live terms of n, and with degree 2 of their products."""
    if degree == 1:
        return live

    def products(terms: Column) -> Column:
        at = [F.get(terms, F.lit(a)) for a in range(count)]
        return F.concat(terms, F.array(*[_entry(_rank(p["i"], q["i"], n), p["value"] * q["value"]) for a, p in enumerate(at) for q in at[a:]]))

    return let(live, products)


def _filled(entries: Column, n: int) -> Column:
    """The dense array of (i, value), each i once."""
    every = F.sequence(F.lit(0), F.lit(n - 1))
    return let(F.map_from_entries(entries), lambda found: F.transform(every, lambda i: F.coalesce(F.element_at(found, i), F.lit(0.0))))


class BSplineBasis(Basis):
    """n_knots B-splines for each axis on equally spaced points between the least and greatest value of
    all axes; goes on outside. periodic: splines that wrap round, on n_knots - 1 equal intervals."""

    def __init__(self, dim_x: int = 1, n_knots: int = 5, degree: int = 3, periodic: bool = False, combine: bool = False):
        self.dim_x, self.n_knots, self.degree, self.periodic, self.combine = dim_x, n_knots, degree, periodic, combine
        each = n_knots - 1 if periodic else n_knots
        self.n_basis = n_products(each * dim_x, dim_x) if combine else each * dim_x
        self.low = self.high = 0.0

    def fit(self, df: DataFrame) -> BSplineBasis:
        row = df.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
        self.low, self.high = float(row[0]), float(row[1])
        return self

    def _polynomials(self):
        points, k = np.linspace(self.low, self.high, self.n_knots), self.degree
        if not self.periodic:
            knots = spline_knots(points, k)
            return spline_polynomials(knots, np.eye(len(knots) - k - 1)[:, : self.n_knots], k)
        m, step = self.n_knots - 1, points[1] - points[0]
        knots = self.low + step * np.arange(-k, m + k + 1)
        fold = np.zeros((m + k, m))
        fold[np.arange(m + k), np.arange(m + k) % m] = 1
        breaks, polynomials = spline_polynomials(knots, fold, k)
        return np.r_[breaks[:-1], self.high], polynomials

    def sparse(self, x: str | Column) -> Column:
        """The degree + 1 live splines of each axis, and with combine their products."""
        k, each = self.degree, self.n_knots - 1 if self.periodic else self.n_knots
        if each <= k or self.combine and self.dim_x > 2:
            return super().sparse(x)
        points = np.linspace(self.low, self.high, self.n_knots)
        if self.periodic:
            step = points[1] - points[0]
            breaks, first, live = live_splines(self.low + step * np.arange(-k, each + k + 1), k)
        else:
            knots = spline_knots(points, k)
            if len(knots) - k - 1 != each:
                return super().sparse(x)
            breaks, first, live = live_splines(knots, k)
        starts, firsts, known = numbers(breaks[:-1]), numbers(first), numbers(live)

        def of_axis(axis: int) -> Column:
            v = _x(x, axis)
            if self.periodic:
                v = F.pmod(v - self.low, F.lit(self.high - self.low)) + self.low

            def terms(place: Column) -> Column:
                out, at = [], place["at"]
                d = place["v"] - F.get(starts, at)
                for j in range(k + 1):
                    value = F.lit(0.0)
                    for p in range(k, -1, -1):
                        value = value * d + F.get(known, (at * (k + 1) + j) * (k + 1) + p)
                    spline = F.get(firsts, at).cast("int") + j
                    out.append(_entry((F.pmod(spline, F.lit(each)) if self.periodic else spline) * self.dim_x + axis, value))
                return F.array(*out)

            return let(F.struct(v.alias("v"), interval(v, breaks).alias("at")), terms)

        found = F.concat(*[of_axis(a) for a in range(self.dim_x)])
        return _entries(found, (k + 1) * self.dim_x, each * self.dim_x, self.dim_x if self.combine else 1)

    def column(self, x: str | Column) -> Column:
        each = self.n_knots - 1 if self.periodic else self.n_knots
        if self.n_basis > INLINE and each > self.degree and (not self.combine or self.dim_x <= 2):
            return _filled(self.sparse(x), self.n_basis)
        breaks, polynomials = self._polynomials()
        axes = []
        for axis in range(self.dim_x):
            v = _x(x, axis)
            if self.periodic:
                v = F.pmod(v - self.low, F.lit(self.high - self.low)) + self.low
            axes.append(piecewise(v, breaks, polynomials))
        terms = [axes[a][i] for i in range(polynomials.shape[2]) for a in range(self.dim_x)]
        return F.array(*(_products(terms, self.dim_x) if self.combine else terms))


class CustomBasis(Basis):
    """A function of the array column x to a list of n_basis columns, or a pandas UDF to an array."""

    def __init__(self, fn: Callable[[Column], list[Column] | Column], n_basis: int, dim_x: int = 1):
        self.fn, self.n_basis, self.dim_x = fn, n_basis, dim_x

    def column(self, x: str | Column) -> Column:
        out = self.fn(F.col(x) if isinstance(x, str) else x)
        return out if isinstance(out, Column) else F.array(*out)

    def to_row(self, spark: SparkSession) -> DataFrame:
        raise ValueError("a basis of user code cannot be written")


def digitize(df: DataFrame, edges: list[list[float]], x: str = "x") -> DataFrame:
    """df with cells: for each axis the number of edges that the value reaches."""

    def cell(axis: int, of: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in of]), lambda e: e <= _x(x, axis)))

    cells = [cell(i, es) for i, es in enumerate(edges)]
    return df.withColumn("cells", F.array(*cells))


def project_on_basis(df: DataFrame, basis: Basis, y: str = "x", dim_y: int = 1, sparse: bool = False) -> np.ndarray:
    """Least-squares coefficients (dim_y, n_basis) of y on the basis, without intercept, from one Gram
    matrix of (y, basis), which tasks sum over their batches. sparse: only of live elements."""
    from ..operators.gram import gram_matrix

    rows = basis.attach(df.withColumn("_y", F.transform(F.slice(y, 1, dim_y), lambda v: v.cast("double"))), "_b", sparse)
    gram, n = gram_matrix(rows, "_y", dim_y, "_b", basis.n_basis)
    gram = gram / max(n, 1)
    return np.linalg.lstsq(gram[dim_y:, dim_y:], gram[dim_y:, :dim_y], rcond=None)[0].T
