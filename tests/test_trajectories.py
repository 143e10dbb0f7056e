"""Sources, bases, free energies and estimation against NumPy or stated values."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from trajspark.functions import basis as B
from trajspark.functions import quantiles
from trajspark.functions.freeenergy import MeanForceBasis, fit_free_energy
from trajspark.functions.linear import as_matrices, expm, lyapunov, m_step
from trajspark.operators import correlation, em, model, resample, statespace
from trajspark.operators.transitions import transitions
from trajspark.plans.queries import QUERIES, S1, F1, e1, e2, m1, pairs
from trajspark.sources import ranges, read_trajectories, trajectory_summary, validate
from trajspark.sources.trajectories import count_bad_rows


def test_read_text(spark, tmp_path):
    (tmp_path / "a.dat").write_text("# t x1 x2\n 2.0  1 10\n2.5\t2   20\n\n3.0 3 30\n3.5 4 40\n")
    (tmp_path / "b.dat").write_text("0 5 50\n1 6 60\n")
    rows = read_trajectories(spark, [str(tmp_path / "a.dat"), str(tmp_path / "b.dat")], 2, max_length=3).orderBy("traj_id", "step").collect()
    assert [(r.step, r.t, r.x) for r in rows] == [(0, 0.0, [1, 10]), (1, 0.5, [2, 20]), (2, 1.0, [3, 30]), (0, 0.0, [5, 50]), (1, 1.0, [6, 60])]


def test_read_named_text(spark, tmp_path):
    """Files that hold rows of several trajectories, and a trajectory in several files."""
    from pathlib import Path

    (tmp_path / "a.txt").write_text("# id t x1 x2\nu 2 1 10 9\nw 0 5 50\n\nu 3 2 20\n")
    (tmp_path / "b.txt").write_text("u 1 0 0\nw 1 6\n")
    rows = read_trajectories(spark, str(tmp_path), 2, bad_rows="drop", named=True).collect()
    assert sorted((r.traj_id, r.step, r.t, r.x) for r in rows) == [("u", 0, 0.0, [0, 0]), ("u", 1, 1.0, [1, 10]), ("u", 2, 2.0, [2, 20]), ("w", 0, 0.0, [5, 50])]
    assert sorted(tuple(r) for r in count_bad_rows(spark, str(tmp_path), 2, named=True).collect()) == [("u", 3, 0, None), ("w", 2, 1, "w 1 6")]
    # the query's files do not grow with the number of trajectories
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.rglob("*.txt"))
    n = QUERIES["read_text"](spark, DATA).select("traj_id").distinct().count()
    assert 0 < len(set(shared.rglob("*.txt")) - before) <= 4 < n


def test_validate(spark):
    df = e1(spark, DATA)
    assert validate(df) == 1.0
    assert trajectory_summary(df).where("n_bad > 0").count() == 0
    with pytest.raises(ValueError):
        validate(df.where("step < 3"))
    with pytest.raises(ValueError):
        validate(df.withColumn("x", F.when(F.col("step") == 1, F.array(F.lit(float("nan")))).otherwise(F.col("x"))))
    with pytest.raises(ValueError):
        validate(df.withColumn("t", F.col("t") * F.col("t")))


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_bspline(spark, degree):
    df = e1(spark, DATA)
    basis = B.BSplineBasis(1, 6, degree).fit(df)
    x = df.select(F.get("x", F.lit(0)).alias("v"), basis.column("x").alias("b")).toPandas()
    knots = B.spline_knots(np.linspace(basis.low, basis.high, 6), degree)
    want = B.design(knots, x["v"].to_numpy(), degree)[:, :6]
    np.testing.assert_allclose(np.stack(x["b"]), want, atol=1e-9)
    if len(knots) - degree - 1 == 6:
        np.testing.assert_allclose(want.sum(axis=1), 1)


def test_periodic_bspline(spark):
    df = e1(spark, DATA)
    basis = B.BSplineBasis(1, 6, 3, periodic=True).fit(df)
    span = basis.high - basis.low
    both = df.select(basis.column("x").alias("a"), basis.column(F.transform("x", lambda v: v + span)).alias("b")).toPandas()
    np.testing.assert_allclose(np.stack(both["a"]), np.stack(both["b"]), atol=1e-9)
    np.testing.assert_allclose(np.stack(both["a"]).sum(axis=1), 1)


@pytest.mark.parametrize("strategy", ["uniform", "quantile", "kmeans"])
def test_bins(spark, strategy):
    df = e1(spark, DATA)
    basis = B.BinsBasis(1, 4, strategy).fit(df)
    hot = np.stack(df.select(basis.column("x").alias("b")).toPandas()["b"])
    assert (hot.sum(axis=1) == 1).all() and (hot.sum(axis=0) > 0).all()


def test_basis_round_trip(spark, tmp_path):
    df = e2(spark, DATA)
    one = e1(spark, DATA)
    for basis, data in [(B.LinearBasis(2, True), df), (B.PolynomialBasis(2, 2), df), (B.BinsBasis(2, 3), df), (B.BSplineBasis(2, 4), df), (MeanForceBasis(fit_free_energy(one)), one)]:
        path = str(tmp_path / type(basis).__name__)
        basis.fit(data).to_row(spark).write.parquet(path)
        again = B.Basis.from_row(spark.read.parquet(path).first())
        both = data.select(basis.column("x").alias("a"), again.column("x").alias("b")).where("a <> b")
        assert again.n_basis == basis.n_basis and both.count() == 0


def test_exact_quantiles(spark, monkeypatch):
    """Equal to percentile, whatever the number of values kept at last; nulls, ties and a far outlier."""
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), 7.0, None) for a, b in zip(rng.normal(size=5000), rng.integers(0, 3, 5000), strict=True)] + [(None, 1e300, 7.0, None), (-1e300, None, 7.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    at = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, at))) for c in "abc"]).first()
    for few in (1, 100, 1_000_000):
        monkeypatch.setattr(quantiles, "FEW", few)
        got = quantiles.exact_quantiles(df, [F.col(c) for c in "abcd"], at)
        np.testing.assert_allclose(got[:3], [list(w) for w in want], rtol=1e-14)
        assert all(np.isnan(got[3]))


def test_numbered(spark, monkeypatch):
    for long in (1 << 20, 100):
        monkeypatch.setattr(ranges, "LONG", long)
        rows, n = resample.numbered(spark.range(1000).selectExpr("id * 7 % 1000 as k").repartition(5), "k")
        assert n == 1000 and rows.where("k <> _no").count() == 0 and rows.select("_no").distinct().count() == 1000
    assert resample.numbered(spark.range(0).toDF("k"), "k")[1] == 0
    assert resample.bootstrap_weights(spark.createDataFrame([], "traj_id long")).count() == 0


def test_free_energy_spline_meets_points(spark):
    free = fit_free_energy(e1(spark, DATA))
    points = spark.createDataFrame([(float(c),) for c in free.axes[0]], "c double").select(F.array("c").alias("x"))
    got = points.select(MeanForceBasis(free).potential("x").alias("v")).toPandas()["v"]
    np.testing.assert_allclose(got, free.values, atol=1e-6)


def test_free_energy_two_dimensions(spark):
    for kind in ("histogram", "kde"):
        free = fit_free_energy(e2(spark, DATA), 2, kind, bandwidth=0.2)
        basis = MeanForceBasis(free)
        x, y = float(free.axes[0][3]), float(free.axes[1][2])
        h = 1e-4
        at = spark.createDataFrame([(x, y), (x + h, y), (x - h, y), (x, y + h), (x, y - h)], "a double, b double").select(F.array("a", "b").alias("x"))
        got = at.select(basis.potential("x").alias("v"), basis.column("x").alias("f")).toPandas()
        v = got["v"]
        assert abs(v[0] - free.values[3, 2]) < 1e-6
        np.testing.assert_allclose(got["f"][0], [-(v[1] - v[2]) / (2 * h), -(v[3] - v[4]) / (2 * h)], atol=1e-4)
    with pytest.raises(NotImplementedError):
        fit_free_energy(e2(spark, DATA), 3)


def _dense(m, v, v_plus, bk):
    """Smoothed means by solving for all hidden states at once."""
    T, d, k = len(v), m.d, m.m
    q = np.linalg.inv(m.noise)
    p, b = np.zeros(((T + 1) * k, (T + 1) * k)), np.zeros((T + 1) * k)
    p[:k, :k] += np.linalg.inv(m.sig0)
    b[:k] += np.linalg.solve(m.sig0, m.mu0)
    c = m.drift(v, bk)
    for t in range(T):
        e = np.zeros((d + k, (T + 1) * k))  # residual = y - e h
        e[:, t * k : (t + 1) * k] = m.r
        e[d:, (t + 1) * k : (t + 2) * k] = -np.eye(k)
        y = np.r_[v_plus[t], np.zeros(k)] - c[t]
        p += e.T @ q @ e
        b += e.T @ q @ y
    cov = np.linalg.inv(p)
    return (cov @ b).reshape(T + 1, k), cov


def test_smoother_against_dense_solve():
    rng = np.random.default_rng(0)
    f = np.array([[0.4, 0.1, 0.3, 0.0], [0.0, 0.5, 0.1, 0.2], [-0.3, 0.1, 0.5, 0.1], [0.1, -0.2, 0.0, 0.4]])
    a = rng.normal(size=(4, 4))
    m = statespace.StateModel(f, rng.normal(size=(2, 3)), a @ a.T + np.eye(4), [0.1, -0.2], np.eye(2) * 0.7, 0.5)
    v, vp, bk = (rng.normal(size=(1, 12, n)) for n in (2, 2, 3))
    mean, cov = _dense(m, v[0], vp[0], bk[0])
    np.testing.assert_allclose(m.means(v, vp, bk)[0], mean, atol=1e-10)
    _, covs, cross = m.smooth_cov(12)
    for t in range(12):
        np.testing.assert_allclose(covs[t], cov[2 * t : 2 * t + 2, 2 * t : 2 * t + 2], atol=1e-10)
        np.testing.assert_allclose(cross[t], cov[2 * t : 2 * t + 2, 2 * t + 2 : 2 * t + 4], atol=1e-10)


def test_smoother_in_chunks(spark):
    """Chunks of 13 transitions give what whole trajectories do; long covariances don't change."""
    trans = pairs(spark, DATA).where("traj_id < 4")
    key = ["traj_id", "step"]
    one, two = (f.toPandas().sort_values(key).reset_index(drop=True) for f in (statespace.smooth_hidden(trans, m1()), statespace.smooth_long(trans, m1(), 13)))
    assert one[[*key, "is_last"]].equals(two[[*key, "is_last"]])
    for c in ("mean", "cov", "cov_lag"):
        here = ~one["is_last"] | (c != "cov_lag")
        np.testing.assert_allclose(*(np.stack(f[c][here]).astype(float) for f in (one, two)), atol=1e-12)
    whole, part = m1().smooth_cov(6000), m1().smooth_part(6000, 0, 6000)
    for a, b in zip(whole, part, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-12)


def test_statistics_in_chunks(spark):
    """Filter, statistics, likelihood and EM by chunks of 13 transitions, two hidden variables too."""
    trans = pairs(spark, DATA).where("traj_id < 12")
    f = np.array([[0.4, 0.3, 0.1], [-0.3, 0.5, 0.1], [-0.1, -0.2, 0.6]])
    for model in (m1(), statespace.StateModel(f, [[-0.2]], f + f.T, [0.3, -0.1], np.eye(2))):
        key = ["traj_id", "step"]
        one, two = (statespace.kalman_filter(trans, model, n).toPandas().sort_values(key).reset_index(drop=True) for n in (None, 13))
        assert one[key].equals(two[key])
        np.testing.assert_allclose(*(np.stack(x["mean"]) for x in (one, two)), atol=1e-10)
        np.testing.assert_allclose(*(np.stack(x["cov"]) for x in (one, two)), atol=1e-10)
        one, two = (statespace.hidden_stats(trans, [model], n).toPandas().sort_values("traj_id").reset_index(drop=True) for n in (None, 13))
        assert one[["traj_id", "n"]].equals(two[["traj_id", "n"]])
        for c in statespace.hidden_sizes(model.d, model.m, 1):
            np.testing.assert_allclose(*(np.stack(x[c]) for x in (one, two)), atol=1e-10)
    # 50 transitions: some trajectories are whole, some are in two chunks
    lls = [[r.ll for r in em.fit_em(statespace.grouped(trans, 3, n), 1, 1, 1, init="user", start=m1(), max_iter=2, tol=0.0).trace.orderBy("iter").collect()] for n in (None, 50)]
    np.testing.assert_allclose(*lls, atol=1e-10)


def test_em_of_replicates(spark):
    """Every split is fitted as if its trajectories were repeated by weight; a stored row is a model."""
    trans = pairs(spark, DATA).where("traj_id < 12")
    weights = spark.createDataFrame([(0, i, 1) for i in range(12)] + [(1, 2, 3), (1, 5, 1)], "split_id int, traj_id long, weight long")
    options = {"init": "user", "start": m1(), "max_iter": 3, "tol": 0.0}
    fit = em.fit_em(trans, 1, 1, 1, weights=weights, **options)
    alone = em.fit_em(trans, 1, 1, 1, **options)
    repeated = trans.where("traj_id in (2, 5)").withColumn("copy", F.explode(F.expr("sequence(0, if(traj_id = 2, 2, 0))"))).withColumn("traj_id", F.expr("traj_id * 10 + copy"))
    for split, other in ((0, alone), (1, em.fit_em(repeated, 1, 1, 1, **options))):
        np.testing.assert_allclose(fit.every[split].friction, other.best.friction, atol=1e-10)
        np.testing.assert_allclose(fit.every[split].noise, other.best.noise, atol=1e-10)
    for row in fit.models.collect():
        back = statespace.StateModel.from_row(row)
        for c in ("friction", "force", "noise", "mu0", "sig0"):
            np.testing.assert_allclose(getattr(back, c), getattr(fit.every[row["model_id"]], c), atol=1e-12)


def test_part_of_a_start_is_given(spark):
    trans = pairs(spark, DATA).where("traj_id < 12")
    fit = em.fit_em(trans, 1, 1, 1, init="user", start={"friction": m1().friction}, n_init=2, max_iter=1)
    first = fit.trace.orderBy("init").collect()
    assert len(first) == 2 and all(np.allclose(r.a, m1().friction.ravel()) for r in first)
    assert first[0].force != first[1].force


def test_em_goldens(spark):
    """Likelihoods of three iterations rise, the force is the memoryless one, partitions don't matter."""
    trans = pairs(spark, DATA)
    fit = em.fit_em(trans, 1, 1, 1, init="user", start=m1(), max_iter=4, tol=0.0)
    ll = [r.ll for r in fit.trace.orderBy("iter").collect()]
    assert len(ll) == 4 and all(b > a for a, b in zip(ll, ll[1:], strict=False))
    assert abs(fit.models.first().force[0] - -0.322266) < 1e-5
    for n in (1, 5):
        assert abs(statespace.score(statespace.grouped(trans, n), [m1()])[0] - ll[0]) < 1e-9


def test_warm_start_and_convergence(spark):
    trans = pairs(spark, DATA)
    fit = em.fit_em(trans, 1, 1, 1, init="user", start=m1(), max_iter=3, tol=0.0)
    more = em.fit_em(trans, 1, 1, 1, warm_start=fit.best, max_iter=5, tol=10.0)
    row = more.models.first()
    assert row.converged and row.n_iter == 2 and row.ll >= fit.models.first().ll


def test_m_step_variants():
    """The joint step solves its normal equations; without hidden parts both give one force."""
    rng = np.random.default_rng(1)
    v, b = rng.normal(size=(500, 2)), rng.normal(size=(500, 3))
    dv = -v @ np.array([[0.5, 0.1], [0.0, 0.3]]).T + b @ rng.normal(size=(3, 2)) + rng.normal(size=(500, 2))
    row = {"xx": v.T @ v, "xdx": v.T @ dv, "dxdx": dv.T @ dv, "bkx": b.T @ v, "bkdx": b.T @ dv, "bkbk": b.T @ b}
    s = as_matrices({k: a / 500 for k, a in row.items()}, 2, 0, 3)
    one, two = (m_step(s, 2, 1.0, np.zeros((2, 3)), None, kind) for kind in ("force_visible", "joint"))
    for a, c in zip(one, two, strict=True):
        np.testing.assert_allclose(a, c, atol=1e-10)
    want = np.linalg.lstsq(np.c_[-v, b], dv, rcond=None)[0].T
    np.testing.assert_allclose(np.c_[one[0], one[1]], want, atol=1e-10)


def test_gauge_keeps_kernel(spark):
    rng = np.random.default_rng(2)
    a, c = rng.normal(size=(4, 4)) * 0.2 + np.eye(4), rng.normal(size=(4, 4))
    row = {"model_id": 0, "dim_x": 1, "dim_h": 3, "a": a.ravel().tolist(), "c": (c @ c.T).ravel().tolist()}
    models = spark.createDataFrame([row], "model_id int, dim_x int, dim_h int, a array<double>, c array<double>")
    turned = model.diagonal_gauge(models).crossJoin(models.select("dim_x", "dim_h"))
    one, two = (model.memory_kernel(m, 10, 0.3).orderBy("n").toPandas()["value"] for m in (models, turned))
    np.testing.assert_allclose(one, two, atol=1e-9)
    hidden = np.array(turned.first().c).reshape(4, 4)[1:, 1:]
    np.testing.assert_allclose(hidden, np.diag(np.diag(hidden)), atol=1e-9)
    times = spark.createDataFrame([(0.3 * i,) for i in range(10)], "t double")
    modes = model.prony_eval(model.prony_modes(models), times).orderBy("t").toPandas()["value"]
    np.testing.assert_allclose(modes, model.memory_kernel(models, 10, 0.3, no_dirac=True).orderBy("n").toPandas()["value"], atol=1e-9)


def test_prony_fit_finds_modes(spark):
    t = 0.1 * np.arange(60)
    y = 2 * np.exp(-0.5 * t) - 0.7 * np.exp(-2 * t)
    series = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, y, strict=True)], "series_id int, t double, value double")
    got = model.prony_fit(series, 2).toPandas()
    np.testing.assert_allclose(got["rate_re"], [-0.5, -2], atol=1e-6)
    np.testing.assert_allclose(got["amp"] * np.cos(got["phase"]), [2, -0.7], atol=1e-6)


def test_small_matrices():
    a = np.array([[0.0, 1.0], [-1.0, 0.0]])
    np.testing.assert_allclose(expm(a * 2), [[np.cos(2), np.sin(2)], [-np.sin(2), np.cos(2)]], atol=1e-12)
    c = lyapunov(F1, S1)
    np.testing.assert_allclose(F1 @ c + c @ F1.T, S1, atol=1e-12)


def test_transitions_shuffle_once(spark):
    """One exchange from the source to the statistics of each trajectory."""
    from trajspark.operators.transitions import trajectory_stats

    plan = trajectory_stats(transitions(e1(spark, DATA), B.LinearBasis()), 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_correlation_all_lags(spark):
    """Every lag below half the length, over several blocks, for two columns and without the mean."""
    rng = np.random.default_rng(3)
    series = {1: rng.normal(size=(2649, 2)), 2: rng.normal(size=(1024, 2)), 3: rng.normal(size=(5, 2)), 4: rng.normal(size=(1, 2))}
    df = spark.createDataFrame([(i, k, float(x), float(y)) for i, s in series.items() for k, (x, y) in enumerate(s)], "traj_id int, step long, p double, q double")
    got = correlation.correlation(df, "p", "q", subtract_mean=True).toPandas()
    for i, s in series.items():
        n, (a, b) = len(s), (s - s.mean(0)).T
        rows = got[got["traj_id"] == i].sort_values("lag")
        assert rows["lag"].tolist() == list(range(n // 2))
        np.testing.assert_allclose(rows["value"], [a[: n - k] @ b[k:] / (n - k) for k in range(n // 2)], atol=1e-9)
