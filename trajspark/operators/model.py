"""Tables of fitted models: criteria, kernels, friction, modes and force fields."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import expm, lyapunov
from ..functions.quantiles import grouped_quantiles


def information_criteria(models: DataFrame, n: int, count_force: bool = False) -> DataFrame:
    """models (dim_x, dim_h, ll, force) with aic, bic and their ranks; lower is better."""
    d, m = F.col("dim_x"), F.col("dim_h")
    p = 2 * (d + m) * (d + m) + m + m * m + (F.size("force") if count_force else F.lit(0))
    out = models.withColumn("aic", -2 * F.col("ll") * n + 2 * p).withColumn("bic", -2 * F.col("ll") * n + p * F.log(F.lit(float(n))))
    rank = lambda c: F.row_number().over(Window.orderBy(c, "model_id"))
    return out.withColumns({"aic_rank": rank("aic"), "bic_rank": rank("bic")})


def _square(values, n: int) -> np.ndarray:
    return np.asarray(values, float).reshape(n, n)


def _per_model(models: DataFrame, fn, schema: str) -> DataFrame:
    """fn(row) -> rows of the schema, in batches of models."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(models.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            rows = [r for row in batch.to_pylist() for r in fn(row)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=wanted)

    return models.mapInArrow(run, schema)


def to_user(models: DataFrame) -> DataFrame:
    """model_id, a = F / dt and c, which solves F C + C F' = S, from friction and sst."""

    def one(r):
        n = r["dim_x"] + r["dim_h"]
        f = _square(r["friction"], n)
        yield {"model_id": r["model_id"], "a": (f / r["dt"]).ravel().tolist(), "c": lyapunov(f, _square(r["sst"], n)).ravel().tolist()}

    return _per_model(models, one, "model_id int, a array<double>, c array<double>")


def from_user(models: DataFrame) -> DataFrame:
    """model_id, friction = A dt and sst = F C + C F' from a and c."""

    def one(r):
        n = r["dim_x"] + r["dim_h"]
        f, c = _square(r["a"], n) * r["dt"], _square(r["c"], n)
        yield {"model_id": r["model_id"], "friction": f.ravel().tolist(), "sst": (f @ c + c @ f.T).ravel().tolist()}

    return _per_model(models, one, "model_id int, friction array<double>, sst array<double>")


def _blocks(r) -> tuple[np.ndarray, ...]:
    d = r["dim_x"]
    a = _square(r["a"], d + r["dim_h"])
    return a[:d, :d], a[:d, d:], a[d:, :d], a[d:, d:]


KERNEL = "model_id int, n long, t double, i int, j int, value double"


def _kernel(models: DataFrame, times) -> DataFrame:
    """Rows of kernels at times(r, hh) of each model, all times of a model by one batch of exponentials."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                vv, vh, hv, hh = _blocks(r)
                t = np.asarray(times(r, hh), float)
                k = -vh @ expm(-t[:, None, None] * hh) @ hv
                if r["dirac"] and len(t):
                    k[0] += vv
                d = len(vv)
                n, i, j = (x.ravel().astype(kind) for x, kind in zip(np.indices(k.shape), (np.int64, np.int32, np.int32), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k.size, r["model_id"], np.int32)), pa.array(n), pa.array(np.repeat(t, d * d)), pa.array(i), pa.array(j), pa.array(k.ravel())], ["model_id", "n", "t", "i", "j", "value"])

    return models.mapInArrow(run, KERNEL)


def _kernel_column(models: DataFrame, times: Column) -> DataFrame:
    """Kernels of models with one visible and one hidden variable, as an expression; times is an array."""
    a = [F.get("a", F.lit(i)) for i in range(4)]
    each = models.select("model_id", "a", "dirac", F.posexplode(times).alias("n", "t"))
    value = -a[1] * a[2] * F.exp(-F.col("t") * a[3]) + F.when(F.col("dirac") & (F.col("n") == 0), a[0]).otherwise(0.0)
    return each.select(F.col("model_id").cast("int").alias("model_id"), F.col("n").cast("long").alias("n"), "t", F.lit(0).alias("i"), F.lit(0).alias("j"), value.alias("value"))


def _by_size(models: DataFrame, times, column: Column) -> DataFrame:
    one = (F.col("dim_x") == 1) & (F.col("dim_h") == 1)
    return _kernel_column(models.where(one), column).unionByName(_kernel(models.where(~one), times))


def memory_kernel(models: DataFrame, n_times: int, dt: float, no_dirac: bool = False) -> DataFrame:
    """K(t) = -A_vh exp(-t A_hh) A_hv at t = n dt, plus A_vv at 0 unless no_dirac."""
    column = F.transform(F.sequence(F.lit(0), F.lit(n_times - 1)), lambda n: n * F.lit(float(dt))) if n_times else F.array().cast("array<double>")
    return _by_size(models.withColumn("dirac", F.lit(not no_dirac)), lambda r, hh: dt * np.arange(n_times), column)


def memory_kernel_logspace(models: DataFrame, dt: float, no_dirac: bool = False, n_times: int = 150) -> DataFrame:
    """The kernel from dt to 25 of its longest times, evenly by logarithm; n_times is two at least."""
    end = F.lit(25.0) / F.abs(F.get("a", F.lit(3)))
    gap = (F.log(end) - float(np.log(dt))) / float(n_times - 1)
    column = F.transform(F.sequence(F.lit(0), F.lit(n_times - 1)), lambda n: F.exp(F.lit(float(np.log(dt))) + n * gap))
    return _by_size(models.withColumn("dirac", F.lit(not no_dirac)), lambda r, hh: np.geomspace(dt, 25 / np.abs(np.linalg.eigvals(hh).real).min(), n_times), column)


def memory_timescales(models: DataFrame) -> DataFrame:
    """model_id, mode, re, im: eigenvalues of A_hh, by (re, im)."""

    def one(r):
        for i, e in enumerate(sorted(np.linalg.eigvals(_blocks(r)[3]), key=lambda z: (round(z.real, 12), z.imag))):
            yield {"model_id": r["model_id"], "mode": i, "re": float(e.real), "im": float(e.imag)}

    return _per_model(models, one, "model_id int, mode int, re double, im double")


def friction_matrix(models: DataFrame) -> DataFrame:
    """A_vv - A_vh A_hh^-1 A_hv, the integral of the kernel."""

    def one(r):
        vv, vh, hv, hh = _blocks(r)
        f = vv - vh @ np.linalg.solve(hh, hv)
        for i in range(len(f)):
            for j in range(len(f)):
                yield {"model_id": r["model_id"], "i": i, "j": j, "value": float(f[i, j])}

    return _per_model(models, one, "model_id int, i int, j int, value double")


def diagonal_gauge(models: DataFrame) -> DataFrame:
    """a and c with the hidden block of c diagonal; each new axis points to its largest component."""

    def one(r):
        d, n = r["dim_x"], r["dim_x"] + r["dim_h"]
        c, turn = _square(r["c"], n), np.eye(n)
        v = np.linalg.eigh(c[d:, d:])[1]
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        turn[d:, d:] = v
        yield {"model_id": r["model_id"], "a": (turn.T @ _square(r["a"], n) @ turn).ravel().tolist(), "c": (turn.T @ c @ turn).ravel().tolist()}

    return _per_model(models, one, "model_id int, a array<double>, c array<double>")


MODES = "mode int, amp double, rate_re double, rate_im double, phase double"


def prony_modes(models: DataFrame) -> DataFrame:
    """The kernel's first element as a sum of modes amp * exp(rate t + i phase), by rate."""

    def one(r):
        _, vh, hv, hh = _blocks(r)
        values, right = np.linalg.eig(hh)
        a = -(vh @ right)[0] * np.linalg.solve(right, hv.astype(complex))[:, 0]
        order = sorted(range(len(values)), key=lambda i: (round(values[i].real, 12), values[i].imag))
        for n, i in enumerate(order):
            yield {"model_id": r["model_id"], "mode": n, "amp": float(abs(a[i])), "rate_re": float(-values[i].real), "rate_im": float(-values[i].imag), "phase": float(np.angle(a[i]))}

    return _per_model(models, one, f"model_id int, {MODES}")


def prony_fit(series: DataFrame, n_modes: int) -> DataFrame:
    """series_id and modes of each evenly sampled series (series_id, t, value): linear prediction by
    least squares, roots, amplitudes by least squares."""
    import pandas as pd

    def one(frame):
        frame = frame.sort_values("t")
        y, dt = frame["value"].to_numpy(), float(np.diff(frame["t"].to_numpy()[:2])[0])
        past = np.lib.stride_tricks.sliding_window_view(y[:-1], n_modes)
        ahead = np.linalg.lstsq(past[:, ::-1], -y[n_modes:], rcond=None)[0]
        roots = np.roots(np.r_[1, ahead]).astype(complex)
        amp = np.linalg.lstsq(roots[None, :] ** np.arange(len(y))[:, None], y.astype(complex), rcond=None)[0]
        rate = np.log(roots) / dt
        order = sorted(range(len(rate)), key=lambda i: (-round(rate[i].real, 12), rate[i].imag))
        return pd.DataFrame([{"series_id": frame["series_id"].iloc[0], "mode": n, "amp": abs(amp[i]), "rate_re": rate[i].real, "rate_im": rate[i].imag, "phase": np.angle(amp[i])} for n, i in enumerate(order)])

    return series.groupBy("series_id").applyInPandas(one, f"series_id {dict(series.dtypes)['series_id']}, {MODES}")


#: Rows of a side that is broadcast at most.
BROADCAST_ROWS = 100_000


def _with_each(df: DataFrame, other: DataFrame) -> DataFrame:
    """Every row of df with every row of other, which is what a table of functions at points is."""
    return df.crossJoin(F.broadcast(other) if other.count() <= BROADCAST_ROWS else other)


def prony_eval(modes: DataFrame, times: DataFrame, key: str = "model_id") -> DataFrame:
    """key, t, value: real part of the sum of the modes at each t of times (a short table of its own)."""
    each = _with_each(modes, times.select("t"))
    term = F.col("amp") * F.exp(F.col("rate_re") * F.col("t")) * F.cos(F.col("rate_im") * F.col("t") + F.col("phase"))
    return each.groupBy(key, "t").agg(F.sum(term).alias("value"))


def bands(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """mean, p05 and p95 of the value over replicates; exact, however many there are."""
    return grouped_quantiles(df, by, value, {"p05": 0.05, "p95": 0.95})


def grid(spark, limits: list[tuple[float, float, int]]) -> DataFrame:
    """i_1 .. i_d, x: evenly spaced points of each axis, ends included; 1 to 4 axes. The grid is what
    was asked for, of a stated size."""
    if not 1 <= len(limits) <= 4:
        raise ValueError("grids have 1 to 4 axes")
    total = int(np.prod([n for _, _, n in limits]))
    rows, places, width = spark.range(total), [], total
    for a, (_, _, n) in enumerate(limits):
        width //= n
        places.append((F.floor(F.col("id") / width) % n).cast("int").alias(f"i_{a + 1}"))
    indexed = rows.select(*places)
    points = [F.lit(float(low)) + F.col(f"i_{a + 1}") * (float(high - low) / max(n - 1, 1)) for a, (low, high, n) in enumerate(limits)]
    return indexed.withColumn("x", F.array(*points))


def force_field(limits: list[tuple[float, float, int]], basis, models: DataFrame) -> DataFrame:
    """model_id, i_1 .., x_1 .., f_1 ..: force * basis on the grid, for every model."""
    d = len(limits)
    points = grid(models.sparkSession, limits).withColumn("bk", basis.column("x"))
    each = _with_each(points, models.select("model_id", "force"))
    k = basis.n_basis
    dot = lambda i: F.aggregate(F.zip_with(F.slice("force", i * k + 1, k), "bk", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return each.select("model_id", *[f"i_{a + 1}" for a in range(d)], *[F.get("x", F.lit(a)).alias(f"x_{a + 1}") for a in range(d)], *[dot(a).alias(f"f_{a + 1}") for a in range(d)])


def force_field_2d(limits: list[tuple[float, float, int]], basis, models: DataFrame) -> DataFrame:
    """model_id, i, j, x, y, fx, fy."""
    return force_field(limits, basis, models).toDF("model_id", "i", "j", "x", "y", "fx", "fy")
