"""Long trajectories, large bases and transforms: the spread forms against plain ones."""

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import Window
from pyspark.sql import functions as F

from trajspark.functions import basis as B
from trajspark.functions import freeenergy, quantiles, splines
from trajspark.functions.freeenergy import FreeEnergy, MeanForceBasis, fit_free_energy
from trajspark.functions.linear import expm
from trajspark.operators import correlation, em, gram, model, resample, statespace
from trajspark.operators import transitions as T
from trajspark.operators.markov import fit_markov
from trajspark.plans.queries import e1, e2, m1, pairs
from trajspark.sources import ranges, read_trajectories
from trajspark.sources.trajectories import as_trajectories, count_bad_rows, with_gradient_velocity


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- trajectories over ranges


@pytest.fixture
def tiny_ranges(monkeypatch):
    monkeypatch.setattr(ranges, "RANGE", 5)
    monkeypatch.setattr(ranges, "LONG", 30)


def test_transitions_over_ranges(spark, monkeypatch):
    df = e1(spark, DATA).persist()
    whole = rows_of(T.transitions(df, B.LinearBasis()))
    velocity = rows_of(with_gradient_velocity(df))
    monkeypatch.setattr(ranges, "RANGE", 5)
    spread = T.transitions(df, B.LinearBasis())
    assert rows_of(spread) == whole and len(whole) == df.count() - 2 * df.select("traj_id").distinct().count()
    assert rows_of(with_gradient_velocity(df)) == velocity
    # as windows over whole trajectories have it
    w = Window.partitionBy("traj_id").orderBy("step")
    v = F.lead(F.get("x", F.lit(0))).over(w) - F.get("x", F.lit(0))
    plain = df.select("traj_id", "step", v.alias("v")).withColumn("p", F.lead("v").over(w)).where("p is not null")
    assert rows_of(plain) == [(r[0], r[1], r[3][0], r[4][0]) for r in whole]
    assert "hashpartitioning(traj_id" in spread._jdf.queryExecution().toString() and "_range" in spread._jdf.queryExecution().toString()


def test_missing_steps_have_no_transition(spark, tiny_ranges):
    df = spark.range(20).where("id <> 7").selectExpr("'a' as traj_id", "id as step", "cast(id as double) as t", "array(cast(id * id as double)) as x")
    got = T.transitions(df, B.LinearBasis()).orderBy("step").collect()
    assert [r.step for r in got] == [i for i in range(18) if not {i, i + 1, i + 2} & {7}]
    assert all(r.v == [2.0 * r.step + 1] and r.v_plus == [2.0 * r.step + 3] for r in got)


@pytest.mark.parametrize("time", [None, "ts"])
def test_numbering_by_ranges(spark, monkeypatch, time):
    """A long trajectory among short ones, with a null id, null order values and ties."""
    rows = [("long", (i * 7919) % 500 // 2, i) for i in range(500)] + [(f"s{i % 9}", i, i) for i in range(60)] + [(None, 3, 1), (None, None, 2), (None, 1, 3)]
    df = spark.createDataFrame(rows, "id string, ts long, v long").repartition(6)
    make = lambda: as_trajectories(df, "id", ["ts", "v"], [F.col("v")], 0.5, F.col(time) if time else None)
    plain = rows_of(make())
    monkeypatch.setattr(ranges, "LONG", 40)
    assert rows_of(make()) == plain
    for by in (["ts"], ["v"]):
        steps = as_trajectories(df, "id", by, [F.col("v")]).where("traj_id = 'long'").orderBy("step").collect()
        assert [r.step for r in steps] == list(range(500))
    long = make().where("traj_id = 'long'")
    assert long.select(F.spark_partition_id()).distinct().count() > 1


def test_bad_text_rows(spark, tmp_path):
    (tmp_path / "a.dat").write_text("# t x y\n2.0 1 10\noops 2 20\n1.0 3 30 99\n3.0 4\n4.0 5 x\nnan 6 60\n\n")
    (tmp_path / "b.dat").write_text("0 5 nan\n1 6 60\n1 6 50\n")
    paths = [str(tmp_path / n) for n in ("a.dat", "b.dat")]
    with pytest.raises(Exception, match="bad row in"):
        read_trajectories(spark, paths, 2).collect()
    rows = read_trajectories(spark, paths, 2, bad_rows="drop").orderBy("traj_id", "step").collect()
    assert [(r.step, r.t, str(r.x)) for r in rows] == [(0, 0.0, "[3.0, 30.0]"), (1, 1.0, "[1.0, 10.0]"), (0, 0.0, "[5.0, nan]"), (1, 1.0, "[6.0, 50.0]"), (2, 1.0, "[6.0, 60.0]")]
    assert [(r.n_rows, r.n_bad, r.example) for r in count_bad_rows(spark, paths, 2).orderBy("traj_id").collect()] == [(6, 4, "3.0 4"), (3, 0, None)]
    with pytest.raises(ValueError, match="bad_rows"):
        read_trajectories(spark, paths, 2, bad_rows="skip")


# -- correlations


def brute_correlation(step, a, b, center=False):
    n = step[-1] - step[0] + 1
    dense = [np.full(n, np.nan) for _ in "ab"]
    for d, v in zip(dense, (a, b), strict=True):
        d[np.array(step) - step[0]] = [np.nan if x is None or not np.isfinite(x) else x for x in v]
        if center:
            d -= np.nanmean(d)
    out = {}
    for k in range(n // 2):
        p = dense[0][: n - k] * dense[1][k:]
        p = p[~np.isnan(p)]
        out[k] = p.mean() if len(p) else None
    return out


def series(rng, n, holes):
    a, b = rng.normal(size=n).tolist(), rng.normal(size=n).tolist()
    for i in holes:
        a[i % n], b[(3 * i + 1) % n] = None, float("nan") if i % 2 else float("inf")
    return a, b


@pytest.mark.parametrize(("whole", "piece", "center"), [(1 << 20, 1 << 18, False), (1 << 20, 1 << 18, True), (20, 16, True), (20, 64, False), (1, 1, False)])
def test_correlation_with_missing_values(spark, whole, piece, center):
    """Every form of the transform, on trajectories of many lengths; nulls and steps without rows are missing."""
    rng, rows, want = np.random.default_rng(7), [], {}
    for name, n, holes in (("one", 1, ()), ("two", 2, ()), ("three", 3, (1,)), ("none", 6, range(6)), ("short", 19, ()), ("gaps", 150, (2, 40, 77)), ("full", 300, ()), ("holes", 257, (0, 9, 100))):
        a, b = series(rng, n, holes)
        kept = [i for i in range(n) if name != "gaps" or i % 11 or i == 0]
        rows += [(name, i + 5, a[i], b[i]) for i in kept]
        want[name] = brute_correlation([i for i in kept], [a[i] for i in kept], [b[i] for i in kept], center) if name != "none" or not center else None
    df = spark.createDataFrame(rows, "traj_id string, step long, a double, b double").repartition(5)
    got = {}
    for r in correlation.correlation(df, "a", "b", center, whole=whole, piece=piece).collect():
        got.setdefault(r.traj_id, {})[r.lag] = r.value
    for name, lags in want.items():
        if lags is None:
            continue
        found = got.get(name, {})
        assert sorted(found) == sorted(lags)
        for k, v in lags.items():
            assert (found[k] is None) == (v is None) and (v is None or abs(found[k] - v) < 1e-9), (name, k)
    short = correlation.correlation(df, "a", "b", center, max_lag=2, whole=whole, piece=piece).collect()
    assert {(r.traj_id, r.lag): r.value for r in short} == {(n, k): v for n, lags in got.items() for k, v in lags.items() if k <= 2}


def test_correlation_null_once(spark):
    """One answer, with and without a limit of lags."""
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, None, 2.0, 4.0, 3.0, 5.0, 1.0, 2.0])], "traj_id long, step long, v double")
    one, two = ({r.lag: r.value for r in correlation.correlation(df, "v", max_lag=m).collect()} for m in (3, None))
    assert one == two and abs(one[1] - (8 + 12 + 15 + 5 + 2) / 5) < 1e-12


def test_transform_of_pieces_is_one_transform():
    rng = np.random.default_rng(1)
    x = rng.normal(size=100)
    grid = correlation.Grid(100, 32)
    whole = np.zeros(grid.rows * grid.cols)
    whole[:100] = x
    m = np.fft.fft(np.fft.fft(whole.reshape(grid.rows, grid.cols), axis=0) * grid.phase(0, 0, (grid.rows, grid.cols)), axis=1)
    np.testing.assert_allclose(m.T.ravel(), np.fft.fft(whole), atol=1e-10)


# -- splines and kernels


def test_spline_of_many_places(spark):
    n = 100_000
    free = FreeEnergy([np.linspace(0, 1, n)], np.sin(np.linspace(0, 20, n)), None)
    basis = MeanForceBasis(free)
    df = spark.range(1000).select(F.array(F.rand(3)).alias("x"))
    got = basis.attach(df).select(F.get("x", F.lit(0)).alias("x"), F.get("bk", F.lit(0)).alias("f")).toPandas()
    np.testing.assert_allclose(got["f"], -20 * np.cos(20 * got["x"]), atol=1e-6)
    with pytest.raises(ValueError, match="attach"):
        basis.column("x")


@pytest.mark.parametrize("periodic", [False, True])
def test_attached_and_inline_splines(spark, monkeypatch, periodic):
    """Of uneven and even places, broadcast or joined; both have the same values and slopes."""
    rng = np.random.default_rng(2)
    for places in (np.cumsum(rng.random(12) + 0.1), np.array([0.0, 1, 2, 5, 6, 9, 10])):
        free = FreeEnergy([places], rng.normal(size=len(places)), None, periodic)
        basis = MeanForceBasis(free)
        df = spark.range(300).select("id", F.array(F.rand(1) * 14 - 1).alias("x"))
        inline = df.select("id", basis.column("x").alias("bk"), basis.potential("x").alias("v"))
        for cells in (0, 100):
            monkeypatch.setattr(splines, "BROADCAST_CELLS", cells)
            joined = basis.with_potential(basis.attach(df)).select("id", "bk", "v")
            assert rows_of(joined) == rows_of(inline)


def test_kernels_of_local_support(spark):
    """The same sums as over the whole grid, with places far from every row."""
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=200), 60 + rng.normal(size=50)]
    df = spark.createDataFrame([([float(a), float(b)],) for a, b in zip(x, rng.permutation(x), strict=True)], "x array<double>").repartition(3)
    for axes, h in (([np.linspace(-5, 65, 900)], 0.3), ([np.linspace(-5, 65, 140), np.linspace(-4, 66, 150)], 0.8)):
        points = np.array([r.x for r in df.collect()])
        k = [np.exp(-0.5 * ((a[:, None] - points[None, :, i]) / h) ** 2) for i, a in enumerate(axes)]
        want = (k[0].sum(axis=1) if len(axes) == 1 else k[0] @ k[1].T).ravel()
        got = np.zeros(want.size)
        for r in freeenergy.kernel_sums(df, axes, h).collect():
            got[r.bin] = r.s
        np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-300)


# -- large and sparse bases


BASES = [
    (1, lambda: B.BSplineBasis(1, 9, 3)), (1, lambda: B.BSplineBasis(1, 8, 3, periodic=True)), (2, lambda: B.BSplineBasis(2, 5, 1, combine=True)), (2, lambda: B.BSplineBasis(2, 5, 3, combine=True)), (2, lambda: B.BSplineBasis(2, 7, 3, periodic=True)),
    (2, lambda: B.BinsBasis(2, 4, combine=True)), (2, lambda: B.BinsBasis(2, 5)), (2, lambda: B.BinsBasis(2, 4, "quantile")), (2, lambda: B.PolynomialBasis(2, 3)), (1, lambda: B.BSplineBasis(1, 3, 3, periodic=True)), (1, lambda: B.BSplineBasis(1, 7, 2)),
]


@pytest.mark.parametrize("at", range(len(BASES)))
def test_sparse_is_dense(spark, monkeypatch, at):
    dim, make = BASES[at]
    df = (e1 if dim == 1 else e2)(spark, DATA)
    basis = make().fit(df)
    both = df.select(basis.column("x").alias("dense"), basis.sparse("x").alias("sparse")).toPandas()
    dense = np.stack(both["dense"])
    filled = np.zeros_like(dense)
    for row, entries in zip(filled, both["sparse"], strict=True):
        assert len({e["i"] for e in entries}) == len(entries)
        for e in entries:
            row[e["i"]] = e["value"]
    np.testing.assert_allclose(filled, dense, atol=1e-12)
    assert dense.shape[1] == basis.n_basis
    monkeypatch.setattr(B, "INLINE", 1)
    again = np.stack(df.select(basis.column("x").alias("b")).toPandas()["b"])
    np.testing.assert_allclose(again, dense, atol=1e-12)


@pytest.mark.parametrize(("sparse", "weight"), [(False, "trajectory"), (True, "transition")])
def test_gram_partials(spark, monkeypatch, sparse, weight):
    """Statistics by partial matrices equal those by a column for each product, with and without weights."""
    df = e2(spark, DATA)
    basis = B.BSplineBasis(2, 4, 3).fit(df)
    weights = df.select("traj_id").distinct().select("traj_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("split_id")).withColumn("weight", F.abs(F.hash("traj_id", "split_id")) % 4).where("weight > 0")
    trans = T.transitions(df, basis).persist()
    held = T.transitions(df, basis, sparse=sparse)
    plain = lambda *a: {r.asDict().get("split_id"): r for r in T.visible_stats(trans, 2, 8, *a).collect()}
    monkeypatch.setattr(T, "COLUMNS", 10_000)
    want = [plain(None, weight), plain(weights, weight)]
    per = {r.traj_id: r for r in T.trajectory_stats(trans, 2, 8).collect()}
    monkeypatch.setattr(T, "COLUMNS", 0)
    monkeypatch.setattr(gram, "HELD", 50)
    for known, w in zip(want, (None, weights), strict=True):
        got = {r.asDict().get("split_id"): r for r in T.visible_stats(held, 2, 8, w, weight).collect()}
        assert set(got) == set(known)
        for k in known:
            assert got[k].n == known[k].n
            for s in T.BLOCKS:
                np.testing.assert_allclose(got[k][s], known[k][s], rtol=1e-9, atol=1e-12)
    for r in T.trajectory_stats(held, 2, 8).collect():
        for s in T.BLOCKS:
            np.testing.assert_allclose(r[s], per[r.traj_id][s], rtol=1e-9, atol=1e-12)
    # averages of given statistics, a row an element
    of = T.sizes(2, 8)
    averaged = T.average_stats(spark.createDataFrame(list(per.values())), list(T.BLOCKS), of, [], weights).collect()
    for r in averaged:
        np.testing.assert_allclose(r.bkbk, plain(weights)[r.split_id].bkbk, rtol=1e-9, atol=1e-12)


def test_markov_fit_of_a_large_basis(spark):
    """Sixty splines: no plan of thousands of aggregates."""
    df = e1(spark, DATA)
    basis = B.BSplineBasis(1, 60, 3).fit(df)
    trans = T.transitions(df, basis, sparse=True)
    row = fit_markov(trans, 1, 60).first()
    stats = T.visible_stats(trans, 1, 60)
    assert len(row.force) == 60 and np.isfinite(row.ll)
    assert str(stats._jdf.queryExecution()).count("avg(") < 100
    dense = fit_markov(T.transitions(df, basis), 1, 60).first()
    assert abs(row.ll - dense.ll) < 1e-9


def test_projection_by_gram(spark):
    df = e1(spark, DATA)
    basis = B.BSplineBasis(1, 8, 3).fit(df)
    both = df.select(basis.column("x").alias("b"), F.get("x", F.lit(0)).alias("y")).toPandas()
    want = np.linalg.lstsq(np.stack(both["b"]), both["y"].to_numpy(), rcond=None)[0]
    for sparse in (False, True):
        np.testing.assert_allclose(B.project_on_basis(df, basis, "x", 1, sparse)[0], want, atol=1e-8)


# -- state space and EM


def _model():
    rng = np.random.default_rng(0)
    f = np.array([[0.4, 0.1, 0.3, 0.0], [0.0, 0.5, 0.1, 0.2], [-0.3, 0.1, 0.5, 0.1], [0.1, -0.2, 0.0, 0.4]])
    a = rng.normal(size=(4, 4))
    return statespace.StateModel(f, rng.normal(size=(2, 3)), a @ a.T + np.eye(4), [0.1, -0.2], np.eye(2) * 0.7, 0.5)


def _frame(lengths):
    rng = np.random.default_rng(1)
    rows = [(k, t, rng.normal(size=2), rng.normal(size=2), rng.normal(size=3)) for k, n in enumerate(lengths) for t in range(n)]
    return pd.DataFrame(rows, columns=["traj_id", "step", "v", "v_plus", "bk"]).sample(frac=1, random_state=1)


def test_padded_batches_equal_single_trajectories():
    """Means, covariances and statistics of unequal lengths in one pass, and each by itself."""
    m, frame = _model(), _frame([5, 1, 12, 7, 7, 30, 2, 1])
    alone = {}
    for named, _, v, v_plus, bk, part in statespace._by_length(frame):
        mu, last = m.part_means(m.drift(v, bk), v_plus, part)
        stats = m.statistics(v, v_plus, bk, part)
        for i, k in enumerate(named["traj_id"]):
            alone[k] = ({s: x[i] for s, x in stats.items()}, mu[i], last[i], m.smooth_cov(part.length)[1:])
    seen, batches = 0, list(statespace._padded(frame))
    assert len(batches) < 3
    for named, steps, v, v_plus, bk, part in batches:
        mu, last = m.part_means(m.drift(v, bk), v_plus, part)
        stats = m.statistics(v, v_plus, bk, part)
        lengths, of = np.unique(-part.lengths, return_inverse=True)
        cov, cross = m.covariances(-lengths)
        for i, k in enumerate(named["traj_id"]):
            n = part.lengths[i]
            want, means, end, (cov_k, cross_k) = alone[k]
            seen += 1
            assert steps[i, :n].tolist() == list(range(n))
            for s in want:
                np.testing.assert_allclose(stats[s][i], want[s], atol=1e-12)
            np.testing.assert_allclose(mu[i, : n + 1], means, atol=1e-12)
            np.testing.assert_allclose(last[i], end, atol=1e-12)
            np.testing.assert_allclose(cov[of[i], : n + 1], cov_k, atol=1e-12)
            np.testing.assert_allclose(cross[of[i], :n], cross_k, atol=1e-12)
    assert seen == len(alone)


def test_many_lengths_are_one_batch():
    rng = np.random.default_rng(2)
    lengths = rng.integers(30, 100, 1500)
    ids = np.repeat(np.arange(1500), lengths)
    steps = np.concatenate([np.arange(n) for n in lengths])
    ones = list(np.ones((len(ids), 1)))
    frame = pd.DataFrame({"traj_id": ids, "step": steps, "v": ones, "v_plus": ones, "bk": ones})
    assert len(list(statespace._padded(frame))) == 1
    short = pd.concat([frame, pd.DataFrame({"traj_id": 5000, "step": np.arange(5000), "v": ones[:5000], "v_plus": ones[:5000], "bk": ones[:5000]})])
    assert 1 < len(list(statespace._padded(short))) < 4


def test_chunks_of_many_trajectories(spark):
    """No group of Python is a trajectory's: of many short ones a group has many. Series in one frame give what each gives."""
    trans = pairs(spark, DATA)
    dealt = statespace.grouped(trans, chunk_rows=6, keep=False)
    plan = statespace._chunk_ends(dealt.where("cut"), [m1()])._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("[")[1].split("]")[0] for line in plan.splitlines() if "FlatMapGroupsInPandas" in line]
    assert len(keys) == 2 and not any("traj_id" in k for k in keys)
    rng = np.random.default_rng(4)
    sizes = [1, 7, 2, 4]
    frame = pd.DataFrame({"model_id": 0, "traj_id": np.repeat([None, 2, 5, 9], sizes)} | {k: list(rng.normal(size=(sum(sizes), n))) for k, n in (("a", 4), ("b", 2), ("p", 4), ("q", 4), ("s", 2))})
    at = statespace._series(frame, ["model_id", "traj_id"])
    assert at.tolist() == [0, 1, 8, 10]
    one, end = rng.normal(size=(2, 4, 2))
    starts, ends = statespace._followed(frame, 2, at, one, end)
    whole = statespace._composed(frame, 2, at)
    square = {k: np.stack(frame[k]).reshape(-1, 2, 2) for k in "apq"}
    for i, (low, n) in enumerate(zip(at, sizes, strict=True)):
        x, y = [one[i]], [end[i]]
        for j in range(low, low + n):
            x.append(square["a"][j] @ x[-1] + frame["b"][j])
        for j in range(low + n - 1, low - 1, -1):
            y.append(square["p"][j] @ x[j - low] + square["q"][j] @ y[-1] + frame["s"][j])
        np.testing.assert_allclose(starts[low : low + n], x[:-1], atol=1e-9)
        np.testing.assert_allclose(ends[low : low + n], y[:-1][::-1], atol=1e-9)
        np.testing.assert_allclose(whole["a"][i].reshape(2, 2) @ one[i] + whole["b"][i], x[-1], atol=1e-9)
        np.testing.assert_allclose(whole["p"][i].reshape(2, 2) @ one[i] + whole["q"][i].reshape(2, 2) @ end[i] + whole["s"][i], y[-1], atol=1e-9)


def test_chunks_by_a_tree(spark, monkeypatch):
    """Means at the ends of chunks, over several levels of a tree, equal those of whole trajectories."""
    trans = pairs(spark, DATA).where("traj_id < 4")
    want = rows_of(statespace.smooth_hidden(trans, m1()).select("traj_id", "step", F.round(F.get("mean", F.lit(0)), 9).alias("m"), "is_last"))
    monkeypatch.setattr(statespace, "FAN", 3)
    got = rows_of(statespace.smooth_long(trans, m1(), 6).select("traj_id", "step", F.round(F.get("mean", F.lit(0)), 9).alias("m"), "is_last"))
    assert got == want
    whole = statespace.hidden_stats(trans, [m1(), _other()])
    for columns in (200, 0):  # chunks add up by a column each, or by a row an element
        monkeypatch.setattr(statespace, "COLUMNS", columns)
        stats = statespace.hidden_stats(trans, [m1(), _other()], chunk_rows=6)
        for a, b in zip(*(sorted(x.collect(), key=lambda r: (r.model_id, r.traj_id)) for x in (stats, whole)), strict=True):
            assert a.n == b.n
            for s in ("xx", "xdx", "dxdx", "bkx", "bkdx", "hs", "mu0"):
                np.testing.assert_allclose(a[s], b[s], atol=1e-9)


def _other():
    x = m1(1)
    return statespace.StateModel(x.friction * 0.7, x.force, x.noise * 1.3, [0.4], x.sig0, 1.0, 1)


def test_composed_maps():
    """A map of several chunks is what following them one by one gives."""
    rng, m = np.random.default_rng(0), 2
    for n in (1, 2, 5, 8):
        frame = pd.DataFrame([{k: rng.normal(size=m * m) for k in "apq"} | {k: rng.normal(size=m) for k in "bs"} for _ in range(n)])
        whole = statespace._composed(frame, m)
        x, y = rng.normal(size=m), rng.normal(size=m)
        starts, ends = statespace._followed(frame, m, x, y)
        last, first = frame.iloc[-1], frame.iloc[0]
        square = lambda v: np.reshape(v, (m, m))
        np.testing.assert_allclose(square(whole["a"]) @ x + whole["b"], square(last["a"]) @ starts[-1] + last["b"], atol=1e-9)
        np.testing.assert_allclose(square(whole["p"]) @ x + square(whole["q"]) @ y + whole["s"], square(first["p"]) @ x + square(first["q"]) @ ends[0] + first["s"], atol=1e-9)


def test_plan_by_chunks_reads_once(spark):
    """Chunks are read from one written table, not made again by windows over the source."""
    states = statespace.smooth_hidden(pairs(spark, DATA), m1(), chunk_rows=20)
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "events.parquet" not in plan


def test_groups_are_placed_by_their_number(spark):
    kept = statespace.grouped(pairs(spark, DATA), 8, keep=False)
    rows = kept.select("grp", F.spark_partition_id().alias("at")).distinct().collect()
    assert len(rows) == len({r["at"] for r in rows}) == len({r["grp"] for r in rows}) == 8
    kept = kept.persist()
    kept.count()
    plan = statespace.hidden_stats(kept, [m1()])._jdf.queryExecution().executedPlan().toString()
    # what iterates over the groups neither shuffles nor sorts them again
    assert "Exchange" not in plan.split("InMemoryTableScan")[0] and "Sort" not in plan.split("InMemoryTableScan")[0]
    kept.unpersist()


def test_models_are_dealt_to_tasks(spark, monkeypatch):
    trans = statespace.grouped(pairs(spark, DATA).where("traj_id < 12"), 2)
    models = [m1(i) for i in range(7)]
    whole = rows_of(statespace.hidden_stats(trans, models).select("model_id", "traj_id", "n"))
    want = statespace.score(trans, models)
    monkeypatch.setattr(statespace, "TASK_MODELS", 3)
    spread = statespace.hidden_stats(trans, models)
    assert rows_of(spread.select("model_id", "traj_id", "n")) == whole
    assert spread._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") == 3
    np.testing.assert_allclose(statespace.score(trans, models), want, rtol=1e-14)
    trans.unpersist()


def test_stopped_fit_goes_on(spark, tmp_path):
    """A fit that stops and is called again equals one that never stopped; a finished one is read back."""
    trans = pairs(spark, DATA).where("traj_id < 12")
    fit = lambda n, folder=None: em.fit_em(trans, 1, 1, 1, init="random", n_init=2, max_iter=n, tol=1e-3, seed=4, resume=folder, save_every=2)
    whole = fit(7)
    folder = f"file://{tmp_path}/fit"
    fit(3, folder)
    runs = []
    counted = em.hidden_stats
    em.hidden_stats = lambda *a, **b: runs.append(1) or counted(*a, **b)
    try:
        again = fit(7, folder)
        assert 0 < len(runs) <= 4
        runs.clear()
        third = fit(7, folder)
        assert not runs
    finally:
        em.hidden_stats = counted
    for other in (again, third):
        assert rows_of(other.trace.select("init", "iter")) == rows_of(whole.trace.select("init", "iter"))
        np.testing.assert_allclose([r.ll for r in other.trace.orderBy("init", "iter").collect()], [r.ll for r in whole.trace.orderBy("init", "iter").collect()], rtol=1e-12)
        np.testing.assert_allclose(other.best.friction, whole.best.friction, rtol=1e-9)
        a, b = other.models.first(), whole.models.first()
        assert (a.n_iter, a.converged) == (b.n_iter, b.converged)


def test_equal_models_share_an_e_step(spark, monkeypatch):
    """All replicates start from one model, which is smoothed once; later each has its own."""
    trans = pairs(spark, DATA).where("traj_id < 12")
    weights = resample.bootstrap_weights(e1(spark, DATA).where("traj_id < 12"), 4, 0.9, 2)
    seen, counted = [], em.hidden_stats
    monkeypatch.setattr(em, "hidden_stats", lambda kept, models, *a: seen.append(len(models)) or counted(kept, models, *a))
    fit = em.fit_em(trans, 1, 1, 1, init="user", start=m1(), max_iter=2, tol=0.0, weights=weights)
    assert seen == [1, 4] and fit.models.count() == 4
    alone = em.fit_em(trans, 1, 1, 1, init="user", start=m1(), max_iter=2, tol=0.0, weights=weights.where("split_id = 2"))
    np.testing.assert_allclose(fit.every[2].friction, alone.every[2].friction, rtol=1e-10)


def test_bootstrap_draws_reach_every_trajectory(spark):
    """Draws by 60 bits: each id is as likely as any other."""
    df = spark.range(40).select(F.col("id").alias("traj_id"))
    drawn = resample.bootstrap_weights(df, 200, 1.0, 1).groupBy("traj_id").agg(F.sum("weight").alias("w")).collect()
    assert len(drawn) == 40 and all(120 < r.w < 290 for r in drawn) and sum(r.w for r in drawn) == 8000


# -- tables of models


def test_grouped_quantiles(spark, monkeypatch):
    """As percentile has them, also where a group is numbered by ranges; nulls, ties and groups of one."""
    rng = np.random.default_rng(9)
    rows = [("hot", None, float(v)) for v in np.round(rng.normal(size=300), 1)] + [("few", k, float(k)) for k in range(4)] + [("none", 1, None), ("few", 2, float("nan")), ("few", 2, 5.5), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "a string, b long, v double").repartition(5)
    at = {"low": 0.05, "mid": 0.5, "top": 1.0}
    want = rows_of(df.where("not isnan(v) or v is null").groupBy("a", "b").agg(F.avg("v"), *[F.percentile("v", F.lit(p)) for p in at.values()]))
    for long in (1 << 20, 50):
        monkeypatch.setattr(ranges, "LONG", long)
        got = rows_of(quantiles.grouped_quantiles(df, ["a", "b"], "v", at))
        assert [r[:2] for r in got] == [r[:2] for r in want]
        for g, w in zip(got, want, strict=True):
            assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-12) for x, y in zip(g[2:], w[2:], strict=True))


def test_kernels_as_expression_and_in_batches(spark):
    """One hidden variable: a Column, equal to the exponentials; several: a batch a model, equal to each by itself."""
    rng = np.random.default_rng(2)
    rows = []
    for k, (d, m) in enumerate([(1, 1), (1, 1), (2, 1), (1, 3), (2, 2)]):
        a = 0.2 * rng.normal(size=(d + m, d + m)) + np.eye(d + m)
        rows.append({"model_id": k, "dim_x": d, "dim_h": m, "a": a.ravel().tolist()})
    models = spark.createDataFrame(rows, "model_id int, dim_x int, dim_h int, a array<double>")
    for got, times in ((model.memory_kernel(models, 7, 0.3), lambda hh: 0.3 * np.arange(7)), (model.memory_kernel_logspace(models, 0.1, n_times=9), lambda hh: np.geomspace(0.1, 25 / np.abs(np.linalg.eigvals(hh).real).min(), 9))):
        found = {(r.model_id, r.n, r.i, r.j): (r.t, r.value) for r in got.collect()}
        for r in rows:
            d = r["dim_x"]
            a = np.reshape(r["a"], (d + r["dim_h"], -1))
            for n, t in enumerate(times(a[d:, d:])):
                k = -a[:d, d:] @ expm(-t * a[d:, d:]) @ a[d:, :d] + (a[:d, :d] if n == 0 else 0)
                for i in range(d):
                    for j in range(d):
                        np.testing.assert_allclose(found.pop((r["model_id"], n, i, j)), (t, k[i, j]), atol=1e-10)
        assert not found
    assert model.memory_kernel(models, 0, 0.3).count() == 0
