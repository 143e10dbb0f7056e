"""Models without memory, fitted in one pass over the transitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linear import STATS, as_matrices, log_likelihood, lyapunov, m_step
from ..functions.quantiles import grouped_quantiles
from .transitions import visible_stats

MODEL = "dim_x int, dim_h int, dt double, a array<double>, c array<double>, force array<double>, mu0 array<double>, sig0 array<double>, sst array<double>, ll double, n_iter int, converged boolean"


def _flat(a) -> list[float]:
    return [float(v) for v in np.asarray(a).ravel()]


def model_row(d: int, m: int, dt: float, friction, force, noise, mu0=(), sig0=(), ll=None, n_iter: int = 1, converged: bool = True) -> dict:
    return {"dim_x": d, "dim_h": m, "dt": dt, "a": _flat(friction / dt), "c": _flat(lyapunov(friction, noise)), "force": _flat(force), "mu0": _flat(mu0), "sig0": _flat(sig0), "sst": _flat(noise), "ll": ll, "n_iter": n_iter, "converged": converged}


def solve_markov(stats: DataFrame, dim_x: int, n_basis: int, dt: float = 1.0, key: str | None = None, optimize_force: bool = True, optimize_diffusion: bool = True, force=None, diffusion=None) -> DataFrame:
    """A model of every row of visible statistics (one a key, such as split_id)."""

    def solve(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                s = as_matrices(row, dim_x, 0, n_basis)
                f0 = np.zeros((dim_x, n_basis)) if force is None else np.asarray(force, float).reshape(dim_x, n_basis)
                s0 = None if diffusion is None else np.asarray(diffusion, float).reshape(dim_x, dim_x)
                friction, f, noise = m_step(s, dim_x, dt, f0, s0, optimize_force=optimize_force, optimize_diffusion=optimize_diffusion)
                out.append(({key: row[key]} if key else {}) | model_row(dim_x, 0, dt, friction, f, noise, ll=log_likelihood(s, friction, f, noise, dt)))
            yield pa.RecordBatch.from_pylist(out, schema=wanted)

    schema = (f"{key} {dict(stats.dtypes)[key]}, " if key else "") + MODEL
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(stats.sparkSession.createDataFrame([], schema).schema)
    return stats.select(*([key] if key else []), *STATS).mapInArrow(solve, schema)


def fit_markov(trans: DataFrame, dim_x: int, n_basis: int, dt: float = 1.0, weights: DataFrame | None = None, weight: str = "trajectory", **options) -> DataFrame:
    """One row of coefficients; one a split_id if bootstrap weights are given. Statistics are one
    aggregate with the single shuffle of the transitions; only their few numbers are solved in Python."""
    return solve_markov(visible_stats(trans, dim_x, n_basis, weights, weight), dim_x, n_basis, dt, "split_id" if weights is not None else None, **options)


def fit_bootstrap(trans: DataFrame, weights: DataFrame, dim_x: int, n_basis: int, dt: float = 1.0) -> DataFrame:
    """coefficient ('a', 'c', 'force', 'sst'), i, mean, p05, p95 over the replicates of a bootstrap."""
    models = fit_markov(trans, dim_x, n_basis, dt, weights)
    long = models.select(F.explode(F.array(*[F.struct(F.lit(c).alias("coefficient"), F.col(c).alias("values")) for c in ("a", "c", "force", "sst")])).alias("s")).select("s.coefficient", F.posexplode("s.values").alias("i", "value"))
    return grouped_quantiles(long, ["coefficient", "i"], "value", {"p05": 0.05, "p95": 0.95})
