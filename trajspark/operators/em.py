"""Expectation-Maximisation for models with memory."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import as_matrices, log_likelihood, lyapunov, m_step
from .markov import MODEL, model_row
from .statespace import StateModel, average_hidden, grouped, hidden_stats, score
from .transitions import visible_stats

TRACE = "model_id int, init int, iter int, ll double, change double, a array<double>, c array<double>, force array<double>"


def random_model(d: int, m: int, k: int, dt: float, length: float, seed: int, model_id: int = 0, sig0=None) -> StateModel:
    """A stable start, whatever the draw.

    Each block of the friction is turned @ diag(rates) @ turned', with a random rotation and rates drawn
    evenly by logarithm between once a trajectory and once in 50 steps; the hidden block also has a random
    antisymmetric part and couples to the visible one antisymmetrically. The symmetric part is positive
    by construction, and so is the noise, friction + friction'.
    """
    rng = np.random.default_rng(seed)

    def block(n: int, scale: float) -> np.ndarray:
        turned = np.linalg.qr(rng.standard_normal((n, n)))[0]
        rates = np.exp(rng.uniform(np.log(1 / max(length, 51)), np.log(1 / 50), n))
        return scale * (turned * rates) @ turned.T

    skew = rng.standard_normal((m, m)) / 100 / max(m, 1)
    coupling = np.zeros((d, m))
    np.fill_diagonal(coupling, rng.uniform(0.5, 1.5, min(d, m)) * dt)
    friction = np.block([[block(d, 0.01), coupling], [-coupling.T, block(m, 1.0) + skew - skew.T]])
    return StateModel(friction, -rng.random((d, k)), friction + friction.T, np.zeros(m), np.eye(m) if sig0 is None else sig0, dt, model_id)


@dataclass
class Fit:
    """models: one row a model_id, the best start; trace: a row an iteration; best: the model of
    model_id 0; every: the best models by model_id."""

    models: DataFrame
    trace: DataFrame
    best: StateModel
    every: dict[int, StateModel]


def next_model(row: dict, model: StateModel, variant: str = "force_visible", optimize_force: bool = True, optimize_diffusion: bool = True) -> StateModel:
    """M-step on one model's averaged statistics. The start's mean moves, its covariance stays."""
    s = as_matrices(row, model.d, model.m, model.force.shape[1])
    friction, force, noise = m_step(s, model.d, model.dt, model.force, model.noise, variant, optimize_force, optimize_diffusion)
    return StateModel(friction, force, noise, row["mu0"], model.sig0, model.dt, model.model_id)


def _starts(kept: DataFrame, dim_x: int, dim_h: int, n_basis: int, dt: float, init: str, given: StateModel | dict | None, n_init: int, seed: int, sig0) -> list[StateModel]:
    if init not in ("random", "markov", "user"):
        raise ValueError(f"unknown init {init}")
    if init == "user" and given is None:
        raise ValueError("init='user' needs start")
    if isinstance(given, StateModel):  # equal starts would give equal fits
        return [StateModel(given.friction, given.force, given.noise, given.mu0, given.sig0, dt, 0)]
    length = kept.groupBy("traj_id").count().agg(F.avg("count")).first()[0]
    models = [random_model(dim_x, dim_h, n_basis, dt, length, seed + i, i, sig0) for i in range(n_init)]
    known = dict(given or {})
    if init == "markov":
        row = visible_stats(kept, dim_x, n_basis).first()
        friction, force, noise = m_step(as_matrices(row, dim_x, 0, n_basis), dim_x, dt, np.zeros((dim_x, n_basis)), None)
        for x in models:
            f, s = x.friction.copy(), x.noise.copy()
            f[:dim_x, :dim_x], s[:dim_x, :dim_x] = friction, noise
            x.__init__(f, force, s, x.mu0, x.sig0, dt, x.model_id)
    for x in models if known else []:
        parts = {k: np.asarray(known.get(k, getattr(x, k)), float) for k in ("friction", "force", "noise", "mu0", "sig0")}
        if "friction" in known and "noise" not in known:
            parts["noise"] = parts["friction"] + parts["friction"].T
        x.__init__(**parts, dt=dt, model_id=x.model_id)
    return models


def fit_em(trans: DataFrame, dim_x: int, dim_h: int, n_basis: int, dt: float = 1.0, init: str = "random", start: StateModel | dict | None = None, tol: float = 1e-5, max_iter: int = 100, n_init: int = 1, warm_start: StateModel | None = None, no_stop: bool = False, variant: str = "force_visible", optimize_force: bool = True, optimize_diffusion: bool = True, seed: int = 0, sig0=None, weights: DataFrame | None = None, resume: str | None = None, save_every: int = 5) -> Fit:
    """Iterate E-step, likelihood, M-step until |change| < tol. All starts run in the same job.

    Transitions are dealt and kept once; an iteration is one job without a shuffle of them, which
    brings one row of means a start to the driver, so plans do not grow. A start whose likelihood is
    no number stops. The best start is that of the highest likelihood, with its coefficients after
    the M-step; the trace holds likelihood and coefficients before it.

    start is a model, or with init='user' a dict of some of friction, force, noise, mu0 and sig0; the
    rest is drawn. With the weights of a bootstrap (split_id, traj_id, weight) every split is fitted,
    all in the same jobs, and model_id is its split_id.

    With resume, a folder that outlives the driver, models and trace are written there after every
    save_every iterations; a fit that finds some goes on from the last that are whole, with the same
    result as one that never stopped. The folder belongs to one fit, with its data and options; max_iter may be raised.
    """
    spark, kept = trans.sparkSession, trans if "grp" in trans.columns else grouped(trans)
    if warm_start is not None:
        init, start = "user", warm_start
    splits = [0] if weights is None else sorted(r[0] for r in weights.select("split_id").distinct().collect())  # a number a replicate
    try:
        starts = _starts(kept, dim_x, dim_h, n_basis, dt, init, start if init == "user" else None, n_init, seed, sig0)
        place = {j: (split, x.model_id) for j, (split, x) in enumerate((split, x) for split in splits for x in starts)}
        live = {j: StateModel(x.friction, x.force, x.noise, x.mu0, x.sig0, dt, j) for j, x in enumerate(starts * len(splits))}
        last, trace, best, done = {}, [], {}, {}
        begun = 0
        if resume is not None and (saved := _saved(spark, resume)):
            begun, live, best, last, done, trace = saved[0], *_restored(saved[1:], dim_x, dim_h, dt)
        for i in range(begun, max_iter if live else 0):
            if weights is None:
                stats = hidden_stats(kept, list(live.values()))
            else:
                stats = _of_replicates(kept, live, {j: place[j][0] for j in live})
            rows = average_hidden(stats, dim_x, dim_h, n_basis, weights).collect()  # a row a start
            for row in rows:
                key, model = row["model_id"], live[row["model_id"]]
                split, number = place[key]
                ll = log_likelihood(as_matrices(row, dim_x, dim_h, n_basis), model.friction, model.force, model.noise, dt, row["hs"][0])
                if not np.isfinite(ll):
                    del live[key]
                    continue
                change = ll - last.get(key, -np.inf)
                trace.append({"model_id": split, "init": number, "iter": i, "ll": ll, "change": None if np.isinf(change) else change, "a": (model.friction / dt).ravel().tolist(), "c": lyapunov(model.friction, model.noise).ravel().tolist(), "force": model.force.ravel().tolist()})
                last[key] = ll
                after = next_model(row, model, variant, optimize_force, optimize_diffusion)
                if key not in best or ll >= best[key][0]:
                    best[key] = (ll, after)
                live[key], done[key] = after, (i + 1, done.get(key, (0, False))[1])
                if abs(change) < tol:
                    done[key] = (i + 1, True)
                    if not no_stop:
                        del live[key]
            if resume is not None and ((i + 1) % save_every == 0 or not live or i + 1 == max_iter):
                _save(spark, resume, i + 1, live, best, last, done, trace)
            if not live:
                break
    finally:
        if kept is not trans:
            kept.unpersist()
    rows, every = [], {}
    for split in splits:
        keys = [j for j in best if place[j][0] == split]
        if not keys:
            raise ValueError("no start has a finite likelihood")
        key = max(keys, key=lambda j: best[j][0])
        ll, x = best[key]
        every[split] = StateModel(x.friction, x.force, x.noise, x.mu0, x.sig0, dt, split)
        rows.append({"model_id": split} | model_row(dim_x, dim_h, dt, x.friction, x.force, x.noise, x.mu0, x.sig0, ll, *done[key]))
    return Fit(spark.createDataFrame(rows, f"model_id int, {MODEL}"), spark.createDataFrame(trace, TRACE), every[splits[0]], every)


def _of_replicates(kept: DataFrame, live: dict[int, StateModel], split_of: dict[int, int]) -> DataFrame:
    """Statistics of every replicate's model, with its split. Replicates whose models are equal, as all
    are at the start, share one E-step."""
    first: dict[tuple, int] = {}
    rows = []
    for j, x in live.items():
        content = tuple(np.asarray(getattr(x, k), float).tobytes() for k in ("friction", "force", "noise", "mu0", "sig0"))
        rows.append((first.setdefault(content, j), j, split_of[j]))
    stats = hidden_stats(kept, [live[j] for j in first.values()]).withColumnRenamed("model_id", "_first")
    known = kept.sparkSession.createDataFrame(rows, "_first int, model_id int, split_id int")  # a row a replicate
    return stats.join(F.broadcast(known), "_first").drop("_first")


STATE = "key int, live boolean, friction array<double>, force array<double>, noise array<double>, mu0 array<double>, sig0 array<double>, best_ll double, last double, iterations int, converged boolean"


def _save(spark, folder: str, i: int, live: dict, best: dict, last: dict, done: dict, trace: list) -> None:
    """Two tables of a fit after iteration i: a row a model that goes on or is the best of its start, and the trace."""
    flat = lambda a: np.asarray(a, float).ravel().tolist()
    parts = lambda x: {k: flat(getattr(x, k)) for k in ("friction", "force", "noise", "mu0", "sig0")}
    rows = [{"key": k, "live": True, "best_ll": None} | parts(x) for k, x in live.items()] + [{"key": k, "live": False, "best_ll": ll} | parts(x) for k, (ll, x) in best.items()]
    for r in rows:
        r |= {"last": last.get(r["key"]), "iterations": done.get(r["key"], (0, False))[0], "converged": done.get(r["key"], (0, False))[1]}
    spark.createDataFrame(trace, TRACE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/trace/saved={i}")
    # written last: a state is whole if its trace is
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/saved={i}")


def _saved(spark, folder: str):
    """The last iteration that was written, its state and its trace; None if there is none."""
    from pyspark.errors import AnalysisException

    try:
        state = spark.read.parquet(f"{folder}/state")
    except AnalysisException:
        return None
    i = state.agg(F.max("saved")).first()[0]
    if i is None:
        return None
    rows = state.where(F.col("saved") == i).collect()  # two rows a start
    return i, rows, spark.read.parquet(f"{folder}/trace").where(F.col("saved") == i).drop("saved").collect()


def _restored(saved: tuple, d: int, m: int, dt: float) -> tuple:
    rows, trace = saved
    n = d + m
    live, best, last, done = {}, {}, {}, {}
    for r in rows:
        x = StateModel(np.reshape(r["friction"], (n, n)), np.reshape(r["force"], (d, -1)), np.reshape(r["noise"], (n, n)), r["mu0"], r["sig0"], dt, r["key"])
        if r["live"]:
            live[r["key"]] = x
        else:
            best[r["key"]] = (r["best_ll"], x)
        if r["last"] is not None:
            last[r["key"]] = r["last"]
        done[r["key"]] = (r["iterations"], r["converged"])
    return live, best, last, done, [t.asDict() for t in trace]


def best_start(trace: DataFrame) -> DataFrame:
    """The iteration of the highest likelihood of each model, the first of equals."""
    order = Window.partitionBy("model_id").orderBy(F.col("ll").desc(), "init", "iter")
    return trace.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def with_change(trace: DataFrame) -> DataFrame:
    """trace with change, the step of the likelihood."""
    return trace.withColumn("change", F.col("ll") - F.lag("ll").over(Window.partitionBy("model_id", "init").orderBy("iter")))


def likelihood_curve(train: DataFrame, valid: DataFrame, models: list[StateModel]) -> DataFrame:
    """iter, split, ll: every model of a fit (model_id is the iteration) on both parts."""
    rows = [{"iter": m.model_id, "split": name, "ll": ll} for name, part in (("train", train), ("valid", valid)) for m, ll in zip(models, score(part, models), strict=True)]
    return train.sparkSession.createDataFrame(rows, "iter int, split string, ll double")
