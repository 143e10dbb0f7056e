"""Free energy of positions (minus log density), its mean force and potential."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .basis import Basis, _x
from .quantiles import exact_quantiles
from .splines import PiecewisePolynomials


def histogram_edges(low: float, high: float, n: int, q1: float, q3: float) -> int:
    """Number of bins: range by the smaller of the widths of Sturges and Freedman-Diaconis."""
    sturges, fd = (high - low) / (math.log2(n) + 1), 2 * (q3 - q1) / n ** (1 / 3)
    width = min(sturges, fd) if fd > 0 else sturges
    return max(1, math.ceil((high - low) / width)) if width > 0 else 1


#: Places of a grid at most, by its dimensions: it is a table on the driver and in every task.
GRID = {1: 1_000_000, 2: 250_000}
#: Distance, in bandwidths, from which a Gaussian is below the least double.
REACH = 38.7
#: Places of an axis of a block, whose rows are summed together.
BLOCK = 64


def _bounded(places: list[int]) -> None:
    if math.prod(places) > GRID[len(places)]:
        raise ValueError(f"a grid of {math.prod(places)} places is too large; give bins or a bandwidth, or cut outliers")


class FreeEnergy:
    """axes: grid points of each axis; values: V on the grid (1-D: only where something was counted)."""

    def __init__(self, axes: list[np.ndarray], values: np.ndarray, table: DataFrame, periodic: bool = False):
        self.axes, self.values, self.table, self.periodic = axes, values, table, periodic



def fit_free_energy(df: DataFrame, dim_x: int = 1, estimator: str = "histogram", bins: int | str = "auto", bandwidth: float | str = "scott", periodic: bool = False) -> FreeEnergy:
    """V = -ln(count) by histogram, or -ln p by Gaussian kernels on a grid; d = 1 or 2.

    What reaches the driver is the grid, whose size depends on the range and the rules for bins; one of
    more places than GRID has for its dimensions is an error, for which bins or bandwidth can be given. The
    table of a histogram is (bin, center, count, v) by axis order, that of kernels (bin, center, v).
    """
    if dim_x > 2:
        raise NotImplementedError("free energies have one or two dimensions")
    quartiles = exact_quantiles(df, [_x("x", i) for i in range(dim_x)], [0.25, 0.75])
    row = df.agg(F.count(F.lit(1)), *[f for i in range(dim_x) for f in (F.min(_x("x", i)), F.max(_x("x", i)), F.stddev_pop(_x("x", i)))]).first()
    n, axis = row[0], [(*row[1 + 3 * i : 4 + 3 * i], quartiles[i]) for i in range(dim_x)]
    if estimator == "histogram":
        count = [histogram_edges(a[0], a[1], n, *a[3]) if bins == "auto" and dim_x == 1 else 10 if bins == "auto" else int(bins) for a in axis]
        _bounded(count)
        width = [(a[1] - a[0]) / c for a, c in zip(axis, count, strict=True)]
        cells = [F.least(F.floor((_x("x", i) - axis[i][0]) / width[i]), F.lit(count[i] - 1)).cast("long").alias(f"b{i}") for i in range(dim_x)]
        got = df.select(*cells).groupBy(*[f"b{i}" for i in range(dim_x)]).agg(F.count(F.lit(1)).alias("count"))
        centers = [F.lit(axis[i][0]) + (F.col(f"b{i}") + 0.5) * width[i] for i in range(dim_x)]
        table = got.select(*[F.col(f"b{i}").alias("bin" if dim_x == 1 else f"bin_{i + 1}") for i in range(dim_x)], *[c.alias("center" if dim_x == 1 else f"center_{i + 1}") for i, c in enumerate(centers)], "count", (-F.log("count")).alias("v"))
        found = table.toPandas()
        if dim_x == 1:
            found = found.sort_values("bin")
            return FreeEnergy([found["center"].to_numpy()], found["v"].to_numpy(), table, periodic)
        values = np.zeros(count)
        values[found["bin_1"], found["bin_2"]] = found["v"]
        return FreeEnergy([axis[i][0] + (np.arange(count[i]) + 0.5) * width[i] for i in range(2)], values, table, periodic)
    if estimator != "kde":
        raise ValueError(f"unknown estimator {estimator}")
    spread = min(min(a[2], (a[3][1] - a[3][0]) / 1.34) for a in axis)
    h = spread * {"scott": n, "silverman": n * (dim_x + 2) / 4}[bandwidth] ** (-1 / (dim_x + 4)) if isinstance(bandwidth, str) else float(bandwidth)
    points = [int((a[1] - a[0]) / (0.25 * h)) for a in axis]
    _bounded(points)
    axes = [np.linspace(a[0] - 2 * h, a[1] + 2 * h, m) for a, m in zip(axis, points, strict=True)]
    sums = kernel_sums(df, axes, h)
    scale = n * (h * math.sqrt(2 * math.pi)) ** dim_x
    table = sums.select("bin", (-F.log(F.col("s") / scale)).alias("v"))
    found = table.toPandas().sort_values("bin")
    values = np.full(math.prod(points), np.inf)
    values[found["bin"]] = found["v"]
    if dim_x == 1:
        table = table.withColumn("center", F.lit(float(axes[0][0])) + F.col("bin") * float(axes[0][1] - axes[0][0]))
    return FreeEnergy(axes, values.reshape(points), table, periodic)


def kernel_sums(df: DataFrame, axes: list[np.ndarray], h: float) -> DataFrame:
    """bin (row-major grid place), s: sum over rows of exp(-|x - grid|^2 / 2h^2).

    Rows of a batch are ordered by blocks of the grid, and each block's rows are summed over the places
    within REACH bandwidths of it, outside of which nothing is left of a kernel. Each task gives the
    places that its rows reach; the sums meet by place.
    """
    dim = len(axes)
    gaps = [float(a[1] - a[0]) if len(a) > 1 else 1.0 for a in axes]
    reach = [math.ceil(REACH * h / g) for g in gaps]

    def partial(batches):
        total = np.zeros([len(a) for a in axes])
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(dim)])
            x = x[:, np.isfinite(x).all(axis=0)]
            block = np.stack([np.clip((v - a[0]) / g, 0, len(a) - 1).astype(int) // BLOCK for v, a, g in zip(x, axes, gaps, strict=True)])
            order = np.lexsort(block)
            x, block = x[:, order], block[:, order]
            cuts = np.flatnonzero((np.diff(block, axis=1) != 0).any(axis=0)) + 1
            for start, end in zip([0, *cuts], [*cuts, x.shape[1]], strict=True):
                if start < end:
                    near = tuple(slice(max(0, b * BLOCK - r), (b + 1) * BLOCK + r) for b, r in zip(block[:, start], reach, strict=True))
                    for at in range(start, end, 4096):
                        k = [np.exp(-0.5 * ((a[n][:, None] - v[None, at : min(at + 4096, end)]) / h) ** 2) for a, v, n in zip(axes, x, near, strict=True)]
                        total[near] += k[0].sum(axis=1) if dim == 1 else k[0] @ k[1].T
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total.ravel()[found])], ["bin", "s"])

    return df.select(*[_x("x", i).alias(f"x{i}") for i in range(dim)]).mapInArrow(partial, "bin long, s double").groupBy("bin").agg(F.sum("s").alias("s"))


class MeanForceBasis(Basis):
    """-dV/dx of a fitted free energy: the derivatives of the cubic spline through its grid.

    attach() looks the spline's polynomials up by a join, for grids of any size; column() has them in
    the expression, for small grids. Where V is infinite (no kernel reaches a place) the grid is one
    without that place, in one dimension.
    """

    def __init__(self, free: FreeEnergy):
        self.dim_x = self.n_basis = len(free.axes)
        self.axes, self.values, self.periodic = [a.tolist() for a in free.axes], free.values.tolist(), free.periodic

    def _spline(self) -> PiecewisePolynomials:
        axes, values = [np.array(a) for a in self.axes], np.array(self.values)
        if self.dim_x == 1:
            axes, values = [axes[0][np.isfinite(values)]], values[np.isfinite(values)]
        return PiecewisePolynomials(axes, values, self.periodic and self.dim_x == 1, GRID[self.dim_x])

    def _forces(self) -> list[tuple[int, ...]]:
        return [(1,)] if self.dim_x == 1 else [(1, 0), (0, 1)]

    def _positions(self, x: str | Column) -> list[Column]:
        return [_x(x, i) for i in range(self.dim_x)]

    def column(self, x: str | Column) -> Column:
        return F.array(*[-v for v in self._spline().columns(self._positions(x), self._forces())])

    def attach(self, df: DataFrame, name: str = "bk", sparse: bool = False) -> DataFrame:
        if sparse:
            raise ValueError("every element of a mean force is live")
        found = [f"_f{i}" for i in range(self.dim_x)]
        return self._spline().attach(df, self._positions("x"), self._forces(), found).withColumn(name, F.array(*[-F.col(f) for f in found])).drop(*found)

    def potential(self, x: str | Column) -> Column:
        return self._spline().columns(self._positions(x), [(0,) * self.dim_x])[0]

    def with_potential(self, df: DataFrame, name: str = "v") -> DataFrame:
        return self._spline().attach(df, self._positions("x"), [(0,) * self.dim_x], [name])


def potential(df: DataFrame, free: FreeEnergy) -> DataFrame:
    """df with v, the free energy at x."""
    return MeanForceBasis(free).with_potential(df)
