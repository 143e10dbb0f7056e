"""Unobserved memory variables: filter, smoother and their statistics.

Covariances do not depend on data, so they are made once for each model and length; only means run
along a trajectory, for all trajectories of one length at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linear import STATS, as_matrices, log_likelihood
from ..sources.ranges import Shifted, written
from .transitions import BLOCKS, COLUMNS, average_stats, sums_by_place

#: Rows that a group has, about; longer trajectories than CHUNK_ROWS transitions lie in several groups.
GROUP_ROWS, CHUNK_ROWS = 50_000, 10_000
#: Affine maps of a trajectory's chunks that are followed in one group.
FAN = 1_000
#: Models that one task runs over a group; more are dealt to as many tasks as needed.
TASK_MODELS = 16
#: Times the rows of a batch of trajectories that padding may make of it.
PADDING = 4


@dataclass
class Part:
    """Transitions from `first` on of trajectories of `length`; filtered means at the start and smoothed
    ones at the end, if they are not the model's start and the last filtered mean. Or whole trajectories
    of several lengths, longest first and padded with zeros."""

    first: int
    length: int
    start: np.ndarray | None = None
    end: np.ndarray | None = None
    lengths: np.ndarray | None = None

    def alive(self, t: int, n: int) -> int:
        """How many of n rows, from the first on, have transition t."""
        return n if self.lengths is None else int(np.searchsorted(-self.lengths, -t))


@dataclass
class StateModel:
    """friction F and noise S of size d + m, force (d, k), start mu0, sig0 of the hidden part."""

    friction: np.ndarray
    force: np.ndarray
    noise: np.ndarray
    mu0: np.ndarray
    sig0: np.ndarray
    dt: float = 1.0
    model_id: int = 0
    _filter: list = field(default_factory=list, repr=False)
    _smooth: dict = field(default_factory=dict, repr=False)
    _gains: dict = field(default_factory=dict, repr=False)
    _steady: bool = field(default=False, repr=False)

    def __post_init__(self):
        self.force = np.atleast_2d(np.asarray(self.force, float))
        self.d, self.m = len(self.force), len(self.friction) - len(self.force)
        self.mu0, self.sig0 = np.asarray(self.mu0, float).ravel(), np.asarray(self.sig0, float).reshape(self.m, self.m)
        self.r = np.eye(self.d + self.m)[:, self.d :] - self.friction[:, self.d :]

    @classmethod
    def from_row(cls, row, model_id: int = 0) -> StateModel:
        """The model of a row of a stored table of models, to score with or to start from."""
        d, m, dt = row["dim_x"], row["dim_h"], row["dt"]
        square = lambda c: np.reshape(np.asarray(row[c], float), (d + m, d + m))
        return cls(square("a") * dt, np.reshape(np.asarray(row["force"], float), (d, -1)), square("sst"), row["mu0"], row["sig0"], dt, model_id)

    def filter_cov(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Covariance of the filtered state t, and the gain that leads to state t + 1. From where they
        no longer change on, they are kept once."""
        while len(self._filter) <= t and not self._steady:
            s = self._filter[-1][2] if self._filter else self.sig0
            q = self.noise + self.r @ s @ self.r.T
            d = self.d
            gain = np.linalg.solve(q[:d, :d], q[:d, d:]).T
            after = q[d:, d:] - gain @ q[:d, d:]
            after = 0.5 * (after + after.T)
            self._steady = bool(np.abs(after - s).max() <= 1e-15 * (1 + np.abs(s).max()))
            self._filter.append((s, gain, after))
        return self._filter[min(t, len(self._filter) - 1)][:2]

    def smooth_gain(self, t: int) -> np.ndarray:
        """What leads from the smoothed state t + 1 back to state t, whatever the trajectory's length."""
        s = self.filter_cov(t)[0]
        at = min(t, len(self._filter) - 1)
        if at not in self._gains:
            self._gains[at] = np.linalg.solve((self.noise + self.r @ s @ self.r.T).T, self.r @ s.T).T
        return self._gains[at]

    def covariances(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For different falling lengths: smoothed covariances of the states and Cov(h_t, h_t+1), in one
        pass back over all of them; zero past a length."""
        top = int(lengths[0])
        cov, cross = np.zeros((len(lengths), top + 1, self.m, self.m)), np.zeros((len(lengths), top, self.m, self.m))
        for i, length in enumerate(lengths):
            cov[i, length] = self.filter_cov(int(length))[0]
        for t in range(top - 1, -1, -1):
            k = int(np.searchsorted(-lengths, -t))
            s, g = self.filter_cov(t)[0], self.smooth_gain(t)
            h = g[:, self.d :]
            cross[:k, t] = h @ cov[:k, t + 1]
            cov[:k, t] = cross[:k, t] @ h.T + s - g @ self.r @ s
        return cov, cross

    def smooth_cov(self, length: int):
        """For each of `length` transitions: gain G, smoothed covariance, and Cov(h_t, h_t+1)."""
        if length not in self._smooth:
            g, cov, cross = np.zeros((length, self.m, self.d + self.m)), np.zeros((length + 1, self.m, self.m)), np.zeros((length, self.m, self.m))
            cov[length] = self.filter_cov(length)[0]
            for t in range(length - 1, -1, -1):
                s = self.filter_cov(t)[0]
                g[t] = np.linalg.solve((self.noise + self.r @ s @ self.r.T).T, self.r @ s.T).T
                h = g[t][:, self.d :]
                cross[t] = h @ cov[t + 1]
                cov[t] = h @ cov[t + 1] @ h.T + s - g[t] @ self.r @ s
            self._smooth[length] = g, cov, cross
        return self._smooth[length]

    def smooth_part(self, length: int, low: int, high: int):
        """smooth_cov(length) for the transitions low .. high - 1 and the state high, without a matrix
        for each of very many steps: in the middle nothing changes."""
        if length > 4096:
            self.filter_cov(4096)
            head = len(self._filter)
            if self._steady:
                g, cov, cross = self.smooth_cov(head + 2048)
                still = head + 1024  # steady both from the start and, half-way, from the end
                if np.abs(cov[head] - cov[still]).max() <= 1e-13:
                    t = np.arange(low, high + 1)
                    at = np.where(t < still, t, np.where(t >= length - 1024, t - length + head + 2048, still))
                    return g[at[:-1]], cov[at], cross[at[:-1]]
        g, cov, cross = self.smooth_cov(length)
        return g[low:high], cov[low : high + 1], cross[low:high]

    def drift(self, v: np.ndarray, bk: np.ndarray) -> np.ndarray:
        """c_t of the transitions: what the next state is without hidden part and noise."""
        c = -v @ self.friction[:, : self.d].T
        c[..., : self.d] += v + self.dt * bk @ self.force.T
        return c

    def means(self, v: np.ndarray, v_plus: np.ndarray, bk: np.ndarray, smooth: bool = True) -> np.ndarray:
        """Means of the T + 1 hidden states of n trajectories of T transitions, (n, T + 1, m)."""
        return self.part_means(self.drift(v, bk), v_plus, Part(0, v.shape[1]), smooth)[0]

    def part_means(self, c: np.ndarray, v_plus: np.ndarray, part: Part, smooth: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Means of the n + 1 hidden states of each of some parts of n transitions with drift c, and the
        filtered mean of the last."""
        length, d = c.shape[1], self.d
        mu = np.zeros((len(c), length + 1, self.m))
        mu[:, 0] = self.mu0 if part.start is None else part.start
        for t in range(length):
            k = part.alive(t, len(c))
            u = c[:k, t] + mu[:k, t] @ self.r.T
            mu[:k, t + 1] = u[:, d:] + (v_plus[:k, t] - u[:, :d]) @ self.filter_cov(part.first + t)[1].T
        last = mu[:, length].copy() if part.lengths is None else mu[np.arange(len(c)), part.lengths]
        if smooth:
            if part.end is not None:
                mu[:, length] = part.end
            for t in range(length - 1, -1, -1):
                k = part.alive(t, len(c))
                known = np.concatenate([v_plus[:k, t], mu[:k, t + 1]], axis=1) - c[:k, t] - mu[:k, t] @ self.r.T
                mu[:k, t] += known @ self.smooth_gain(part.first + t).T
        return mu, last

    def maps(self, c: np.ndarray, v_plus: np.ndarray, part: Part) -> dict[str, np.ndarray]:
        """Parts as affine maps of the filtered mean x at their start and the smoothed mean y at their
        end: the filtered mean at the end is a x + b, the smoothed one at the start p x + q y + s."""
        n, m = len(c), self.m
        still = lambda a: np.concatenate([a, np.zeros((2 * m, *a.shape[1:]))])
        unit = np.zeros((2, n + 2 * m, m))
        unit[0, n : n + m] = unit[1, n + m :] = np.eye(m)
        mu, last = self.part_means(still(c), still(v_plus), Part(part.first, part.length, *unit))
        each = lambda x: np.broadcast_to(x.T.ravel(), (n, m * m))
        return {"a": each(last[n : n + m]), "b": last[:n], "p": each(mu[n : n + m, 0]), "q": each(mu[n + m :, 0]), "s": mu[:n, 0]}

    def statistics(self, v, v_plus, bk, part: Part) -> dict[str, np.ndarray]:
        """Second moments over the hidden states of each of some parts, by their share in the trajectory:
        what the parts of a trajectory give adds up to its means."""
        length, m = v.shape[1], self.m
        mu, _ = self.part_means(self.drift(v, bk), v_plus, part)
        now, after = mu[:, :-1], mu[:, 1:]
        if part.lengths is None:
            _, cov, cross = self.smooth_part(part.length, part.first, part.first + length)
            cov, cross, of, count, share = cov[None], cross[None], np.zeros(len(v), int), np.full(len(v), length), length / part.length
            there = np.ones((1, length), bool)
        else:
            lengths, of = np.unique(-part.lengths, return_inverse=True)
            cov, cross = self.covariances(-lengths)
            count, share, there = part.lengths, 1.0, np.arange(length) < -lengths[:, None]
            now, after = now * there[of][:, :, None], after * there[of][:, :, None]
        steps = there.sum(axis=1)
        mean = lambda a, b: np.einsum("nti,ntj->nij", a, b) / count[:, None, None]
        spread = lambda x: ((x * there[:, :, None, None]).sum(axis=1) / steps[:, None, None])[of]
        tt, pp, tp = spread(cov[:, :-1]) + mean(now, now), spread(cov[:, 1:]) + mean(after, after), spread(cross) + mean(now, after)
        dv, dh = v_plus - v, after - now
        join = lambda vv, vh, hv, hh: np.concatenate([np.concatenate([vv, vh], axis=2), np.concatenate([hv, hh], axis=2)], axis=1)
        hv, ddhv = mean(now, v), mean(dh, dv)
        pair = np.concatenate([np.concatenate([cov[:, 1:], cross.swapaxes(2, 3)], axis=3), np.concatenate([cross, cov[:, :-1]], axis=3)], axis=2)
        entropy = 0.5 * m * (1 + math.log(2 * math.pi)) + 0.5 * _mean_log(np.linalg.det(pair), there) - 0.5 * _mean_log(np.linalg.det(cov[:, :-1]), there)
        moments = {
            "xx": join(mean(v, v), hv.transpose(0, 2, 1), hv, tt),
            "xdx": join(mean(v, dv), mean(v, dh), mean(now, dv), tp - tt),
            "dxdx": join(mean(dv, dv), ddhv.transpose(0, 2, 1), ddhv, pp - tp - tp.transpose(0, 2, 1) + tt),
            "bkx": np.concatenate([mean(bk, v), mean(bk, now)], axis=2),
            "bkdx": np.concatenate([mean(bk, dv), mean(bk, dh)], axis=2),
            "bkbk": mean(bk, bk),
            "hs": entropy[of][:, None],
        }
        begins = float(part.first == 0)
        return {k: share * x for k, x in moments.items()} | {"mu0": begins * mu[:, 0], "sig0": begins * cov[of, 0]}


def _mean_log(dets: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Of each row, the mean logarithm of what is positive."""
    good = there & (dets > 0)
    logs = np.log(np.where(good, dets, 1.0)).sum(axis=1)
    return np.where(good.any(axis=1), logs / np.maximum(good.sum(axis=1), 1), np.nan)


def hidden_sizes(d: int, m: int, k: int) -> dict[str, int]:
    n = d + m
    return {"xx": n * n, "xdx": n * n, "dxdx": n * n, "bkx": k * n, "bkdx": k * n, "bkbk": k * k, "mu0": m, "sig0": m * m, "hs": 1}


def grouped(trans: DataFrame, partitions: int | None = None, chunk_rows: int | None = None, keep: bool = True) -> DataFrame:
    """Transitions dealt once and kept: what iterates over them shuffles nothing again.

    A group has some GROUP_ROWS rows, and a partition of its own number. Trajectories of up to
    chunk_rows transitions are whole in one; if there are longer ones, rows have their trajectory's
    length and their chunk too. What is not kept is written once then, as chunks are read several times.
    """
    chunk_rows = chunk_rows or CHUNK_ROWS
    lengths = trans.groupBy("traj_id").agg(F.count(F.lit(1)).alias("length"))
    rows, longest = lengths.agg(F.sum("length"), F.max("length")).first()
    n = partitions or max(trans.sparkSession.sparkContext.defaultParallelism, (rows or 0) // GROUP_ROWS)
    key = ["traj_id"]
    if (longest or 0) > chunk_rows:
        chunk = F.when(F.col("length") > chunk_rows, F.expr(f"step div {chunk_rows}")).otherwise(F.lit(0))
        trans, key = trans.join(lengths, "traj_id").withColumns({"chunk": chunk.cast("long"), "cut": F.col("length") > chunk_rows}), ["traj_id", "chunk"]
    dealt = trans.withColumn("grp", F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")).repartitionById(n, "grp").sortWithinPartitions("grp", "traj_id", "step")
    return dealt.persist() if keep else written(dealt) if "chunk" in dealt.columns else dealt


def _by_length(frame):
    """Ids, steps, rows' places and arrays of the trajectories (or chunks) in a group, those of one
    length (and place in it) at a time, with the part that they are."""
    keys = ["traj_id", "chunk"] if "chunk" in frame else ["traj_id"]
    frame = frame.sort_values([*keys, "step"], kind="stable")
    begins = np.r_[True, (frame[keys].to_numpy()[1:] != frame[keys].to_numpy()[:-1]).any(axis=1)][: len(frame)]
    start = np.flatnonzero(begins)
    size = np.diff(np.r_[start, len(frame)])
    first = frame["step"].to_numpy()[start] if "chunk" in frame else np.zeros(len(start), int)
    length = frame["length"].to_numpy()[start] if "chunk" in frame else size
    columns = [np.stack(frame[c].to_numpy()) for c in ("v", "v_plus", "bk")] if len(frame) else []
    for f, total, n in sorted(set(zip(first.tolist(), length.tolist(), size.tolist(), strict=True))):
        which = np.flatnonzero((first == f) & (length == total) & (size == n))
        rows = start[which][:, None] + np.arange(n)
        named = {k: frame[k].to_numpy()[start[which]] for k in keys}
        yield named, frame["step"].to_numpy()[rows], *[c[rows] for c in columns], Part(f, total)


def _padded(frame):
    """The whole trajectories of a group as few batches: longest first, filled up with zeros to the
    longest; a batch ends where that would make more than PADDING times its rows."""
    frame = frame.sort_values(["traj_id", "step"], kind="stable")
    ids = frame["traj_id"].to_numpy()
    start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][: len(frame)])
    size = np.diff(np.r_[start, len(frame)])
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    columns = [np.stack(frame[c].to_numpy()) for c in ("v", "v_plus", "bk")] if len(frame) else []
    step, low = frame["step"].to_numpy(), 0
    while low < len(size):
        cells = size[low] * np.arange(1, len(size) - low + 1)
        batch = slice(low, low + max(1, int(np.searchsorted(-(PADDING * np.cumsum(size[low:]) - cells), 1e-9))))
        at, lengths = start[batch][:, None] + np.arange(size[low]), size[batch]
        there = np.arange(size[low]) < lengths[:, None]
        at = np.where(there, at, 0)
        yield {"traj_id": ids[start[batch]]}, step[at], *[c[at] * there[:, :, None] for c in columns], Part(0, int(size[low]), lengths=lengths)
        low = batch.stop


def _listed(a: np.ndarray, n: int) -> list:
    return list(np.asarray(a, float).reshape(n, -1))


def _series(frame, keys: list[str]) -> np.ndarray:
    """Where the rows of each different keys begin in a frame that is sorted by them."""
    begins = np.zeros(len(frame), bool)
    begins[:1] = True
    for c in keys:
        x = frame[c].to_numpy()
        null = x != x  # pandas has nulls of numbers as NaN, which are one series
        begins[1:] |= (x[1:] != x[:-1]) & ~(null[1:] & null[:-1])
    return np.flatnonzero(begins)


def _maps_of(frame, m: int) -> list[np.ndarray]:
    shapes = {"a": (m, m), "b": (m, 1), "p": (m, m), "q": (m, m), "s": (m, 1)}
    return [np.reshape(np.stack(frame[k].to_numpy()), (-1, *shape)) for k, shape in shapes.items()]


def _composed(frame, m: int, start: np.ndarray | None = None) -> dict[str, list] | dict[str, np.ndarray]:
    """The maps of chunks that follow each other, as one map for each series of them, which begin at
    start; without it all rows are one series, of which the map itself is returned. Neighbours are joined
    pairwise, so that all pairs of a level are one product."""
    if start is None:
        return {k: x[0] for k, x in _composed(frame, m, np.zeros(1, np.int64)).items()}
    maps = _maps_of(frame, m)
    of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(frame)]))
    place = np.arange(len(frame)) - start[of]
    while len(of) > len(start):
        kept = np.flatnonzero(place % 2 == 0)
        paired = np.r_[of, -1][kept + 1] == of[kept]
        one = kept[paired]
        (a, b, p, q, s), (a2, b2, p2, q2, s2) = ([x[at] for x in maps] for at in (one, one + 1))
        maps = [x[kept] for x in maps]
        for x, joined in zip(maps, (a2 @ a, a2 @ b + b2, p + q @ p2 @ a, q @ q2, s + q @ (p2 @ b + s2)), strict=True):
            x[paired] = joined
        of, place = of[kept], place[kept] // 2
    return {k: _listed(x, len(start)) for k, x in zip("abpqs", maps, strict=True)}


def _followed(frame, m: int, *of: np.ndarray | None) -> tuple[list, list]:
    """Filtered means at the starts and smoothed ones at the ends of chunks that follow each other. Of:
    where series of them begin, the filtered mean at the start of each series and the smoothed one at its
    end (None: the last filtered mean); or only the two means, if all rows are one series. All series take
    a step at a time."""
    if len(of) == 2:
        of = (np.zeros(1, np.int64), *(x if x is None else np.reshape(x, (1, m)) for x in of))
    start, first, end = of
    a, b, p, q, s = _maps_of(frame, m)
    size = np.diff(np.r_[start, len(frame)])
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    at = [start[: int(np.searchsorted(-size, -t))] + t for t in range(size[0])]
    x, starts, ends = first[order][:, :, None], np.empty_like(b), np.empty_like(b)
    for rows in at:
        starts[rows] = x[: len(rows)]
        x[: len(rows)] = a[rows] @ x[: len(rows)] + b[rows]
    y = x if end is None else end[order][:, :, None]
    for rows in at[::-1]:
        ends[rows] = y[: len(rows)]
        y[: len(rows)] = p[rows] @ starts[rows] + q[rows] @ y[: len(rows)] + s[rows]
    return _listed(starts, len(b)), _listed(ends, len(b))


def _chunk_ends(chunks: DataFrame, models: list[StateModel], fan: int | None = None) -> DataFrame:
    """grp, model_id, traj_id, chunk, start, end: filtered mean at the start of each chunk, smoothed mean
    at its end.

    Means of filter and smoother are affine in the mean before (or after), with matrices that don't
    depend on data. So a chunk is one row of affine maps. Up to `fan` maps of a trajectory are followed
    forwards and back in one group, which has many trajectories. Of more, each `fan` are composed to one map, and so on up a tree
    until a trajectory has few; then the means at their ends go down the tree again.
    """
    import pandas as pd

    known, fan = {x.model_id: x for x in models}, fan or FAN
    m, kind = models[0].m, dict(chunks.dtypes)["traj_id"]

    def mapped(frame):
        out = []
        for named, _, v, v_plus, bk, part in _by_length(frame):
            for model in models:
                maps = model.maps(model.drift(v, bk), v_plus, part)
                out.append(pd.DataFrame(named | {"grp": frame["grp"].iloc[0], "model_id": model.model_id} | {k: _listed(x, len(v)) for k, x in maps.items()}))
        return pd.concat(out) if out else None

    def chained(frame):
        if not len(frame):
            return frame[named].assign(start=[], end=[])
        frame = frame.sort_values(["model_id", "traj_id", "chunk"])
        at = _series(frame, ["model_id", "traj_id"])
        begins = np.stack([known[i].mu0 for i in frame["model_id"].to_numpy()[at]])
        starts, ends = _followed(frame, m, at, begins, None)
        return frame[named].assign(start=starts, end=ends)

    def composed(frame):
        frame = frame.sort_values(["model_id", "traj_id", "chunk"])
        at = _series(frame, ["model_id", "traj_id", "_up"])
        of = frame.iloc[at]
        return pd.DataFrame({"grp": 0, "model_id": of["model_id"], "traj_id": of["traj_id"], "chunk": of["_up"]}).assign(**_composed(frame, m, at))

    def below(frame, above):
        if not len(frame):
            return frame[named].assign(start=[], end=[])
        frame, above = frame.sort_values(["model_id", "traj_id", "chunk"]), above.sort_values(["model_id", "traj_id", "chunk"])
        at = _series(frame, ["model_id", "traj_id", "_up"])
        starts, ends = _followed(frame, m, at, *(np.stack(above[c].to_numpy()) for c in ("start", "end")))
        return frame[named].assign(start=starts, end=ends)

    named = ["grp", "model_id", "traj_id", "chunk"]
    key = f"grp int, model_id int, traj_id {kind}, chunk long, "
    shape, ends = key + ", ".join(f"{k} array<double>" for k in "abpqs"), key + "start array<double>, end array<double>"
    levels = [chunks.groupBy("grp").applyInPandas(mapped, shape)]
    most, groups = chunks.agg(F.max("chunk"), F.max("grp")).first()
    most = (most or 0) + 1
    # a task takes many trajectories at once: of many short ones, a group each costs more than its rows
    dealt = lambda df, up: df.withColumns({"_up": up, "_deal": F.pmod(F.xxhash64("model_id", "traj_id", up), F.lit((groups or 0) + 1))}).groupBy("_deal")
    while most > fan:
        levels[-1] = written(levels[-1])  # read on the way up and on the way down
        levels.append(dealt(levels[-1], F.expr(f"chunk div {fan}")).applyInPandas(composed, shape))
        most = -(-most // fan)
    found = dealt(levels.pop(), F.lit(0).cast("long")).applyInPandas(chained, ends)
    while levels:
        found = dealt(levels.pop(), F.expr(f"chunk div {fan}")).cogroup(dealt(found, F.col("chunk"))).applyInPandas(below, ends)
    return found


def _each_part(dealt: DataFrame, models: list[StateModel], run, schema: str) -> DataFrame:
    """run(model, named, steps, v, v_plus, bk, part), a pandas frame, of all trajectories that are whole in
    a group and of all chunks of the longer ones. A task has a group and TASK_MODELS models at most."""
    import pandas as pd

    if len(models) > TASK_MODELS:
        return reduce(DataFrame.union, [_each_part(dealt, models[i : i + TASK_MODELS], run, schema) for i in range(0, len(models), TASK_MODELS)])

    def whole(frame):
        out = [run(model, *args) for args in _padded(frame) for model in models]
        return pd.concat(out) if out else None

    if "chunk" not in dealt.columns:
        return dealt.groupBy("grp").applyInPandas(whole, schema)
    chunks = dealt.where("cut")

    def cut(frame, ends):
        at = ends.set_index(["model_id", "traj_id", "chunk"])
        out = []
        for named, steps, v, v_plus, bk, part in _by_length(frame):
            for model in models:
                found = at.loc[list(zip([model.model_id] * len(v), named["traj_id"], named["chunk"], strict=True))]
                known = Part(part.first, part.length, np.stack(found["start"].to_numpy()), np.stack(found["end"].to_numpy()))
                out.append(run(model, named, steps, v, v_plus, bk, known))
        return pd.concat(out) if out else pd.DataFrame()

    parts = chunks.groupBy("grp").cogroup(_chunk_ends(chunks, models).groupBy("grp")).applyInPandas(cut, schema)
    return dealt.where("not cut").groupBy("grp").applyInPandas(whole, schema).union(parts)


def _states(trans: DataFrame, model: StateModel, smooth: bool, chunk_rows: int | None = None) -> DataFrame:
    import pandas as pd

    def run(model, named, steps, v, v_plus, bk, part):
        n, length = steps.shape
        mean, last = model.part_means(model.drift(v, bk), v_plus, part, smooth)
        none = np.full((1, length + 1, model.m, model.m), np.nan)
        filtered = lambda: np.array([[model.filter_cov(part.first + t)[0] for t in range(length + 1)]])
        ends = np.full(n, length) if part.lengths is None else part.lengths
        if part.lengths is not None and smooth:
            lengths, of = np.unique(-ends, return_inverse=True)
            cov, lag = model.covariances(-lengths)
        else:
            of = np.zeros(n, int)
            cov, lag = (x[None] for x in model.smooth_part(part.length, part.first, part.first + length)[1:]) if smooth else (filtered(), none)
        if part.lengths is not None or part.first + length == part.length:
            # the state after a chunk is the next one's first; the very last is filtered
            mean[np.arange(n), ends] = last
            count = ends + 1
        else:
            count = ends
        place = np.arange(length + 1)
        lag = np.concatenate([lag[:, :length], none[:, :1].repeat(len(lag), axis=0)], axis=1)[of]
        lag = np.where((place < ends[:, None])[:, :, None, None], lag, np.nan)
        kept = place < count[:, None]
        step = np.concatenate([steps, steps[:, -1:] + 1], axis=1)
        step = np.where(place == ends[:, None], step[np.arange(n), np.maximum(ends - 1, 0)][:, None] + 1, step)
        flat = lambda a: list(a[kept].reshape(int(kept.sum()), -1))
        return pd.DataFrame({"traj_id": np.repeat(named["traj_id"], count), "step": step[kept], "mean": flat(mean), "cov": flat(np.broadcast_to(cov[of], (n, *cov.shape[1:]))), "cov_lag": flat(lag), "is_last": (place == ends[:, None])[kept]})

    dealt = trans if "grp" in trans.columns else grouped(trans, chunk_rows=chunk_rows, keep=False)
    return _each_part(dealt, [model], run, f"traj_id {dict(trans.dtypes)['traj_id']}, step long, mean array<double>, cov array<double>, cov_lag array<double>, is_last boolean")


def kalman_filter(trans: DataFrame, model: StateModel, chunk_rows: int | None = None) -> DataFrame:
    """traj_id, step, mean, cov of h_t given v_0 .. v_t; cov_lag is not a number here."""
    return _states(trans, model, False, chunk_rows)


def smooth_hidden(trans: DataFrame, model: StateModel, chunk_rows: int | None = None) -> DataFrame:
    """traj_id, step, mean, cov given the whole trajectory, cov_lag = Cov(h_t, h_t+1), is_last (the
    filtered estimate). Trajectories of more than chunk_rows transitions go by chunks."""
    return _states(trans, model, True, chunk_rows)


def smooth_long(trans: DataFrame, model: StateModel, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """smooth_hidden with chunks of a given size."""
    return smooth_hidden(trans, model, chunk_rows)


def predict_hidden(trans: DataFrame, model: StateModel) -> DataFrame:
    return smooth_hidden(trans, model).select("traj_id", "step", "mean", "is_last")


def hidden_stats(trans: DataFrame, models: list[StateModel], chunk_rows: int | None = None) -> DataFrame:
    """model_id, traj_id, n and the statistics over hidden states: one row a trajectory and model.

    All models run over each group in one job; smoothed states are never rows. Chunks of long
    trajectories give sums that Spark adds up.
    """
    import pandas as pd

    def run(model, named, steps, v, v_plus, bk, part):
        moments = model.statistics(v, v_plus, bk, part)
        return pd.DataFrame({"model_id": model.model_id, "traj_id": named["traj_id"], "n": v.shape[1] if part.lengths is None else part.lengths} | {name: _listed(a, len(v)) for name, a in moments.items()})

    dealt = trans if "grp" in trans.columns else grouped(trans, chunk_rows=chunk_rows, keep=False)
    of = hidden_sizes(models[0].d, models[0].m, models[0].force.shape[1])
    parts = _each_part(dealt, models, run, f"model_id int, traj_id {dict(trans.dtypes)['traj_id']}, n long, " + ", ".join(f"{s} array<double>" for s in of))
    if "chunk" not in dealt.columns:
        return parts
    if sum(of.values()) > COLUMNS:
        return sums_by_place(parts.withColumn("_w", F.lit(1.0)), list(of), of, ["model_id", "traj_id"], F.col("n"))
    total = lambda s: F.array(*[F.sum(F.get(s, F.lit(i))) for i in range(of[s])]).alias(s)
    return parts.groupBy("model_id", "traj_id").agg(F.sum("n").alias("n"), *[total(s) for s in of])


def average_hidden(per_traj: DataFrame, d: int, m: int, k: int, weights: DataFrame | None = None) -> DataFrame:
    of = hidden_sizes(d, m, k)
    return average_stats(per_traj, list(of), of, ["model_id"], weights)


def score(trans: DataFrame, models: list[StateModel]) -> list[float]:
    """Mean log-likelihood of each model, hidden states averaged out, all in one job."""
    first = models[0]
    d, m, k = first.d, first.m, first.force.shape[1]
    rows = {r["model_id"]: r for r in average_hidden(hidden_stats(trans, models), d, m, k).collect()}  # a row a model
    return [log_likelihood(as_matrices(rows[x.model_id], d, m, k), x.friction, x.force, x.noise, x.dt, rows[x.model_id]["hs"][0]) for x in models]


def complete_stats(trans: DataFrame, hidden: DataFrame, d: int, m: int, k: int) -> DataFrame:
    """Statistics with known hidden values (traj_id, step, h array), joined by trajectory and step."""
    near = Shifted(hidden.select("traj_id", "step", "h"), ahead=1)
    ahead = near.own(near.rows.withColumn("h_plus", near.next("h")))
    both = trans.join(ahead, ["traj_id", "step"]).where("h_plus is not null")
    z = [F.get("v", F.lit(i)) for i in range(d)] + [F.get("h", F.lit(i)) for i in range(m)]
    dz = [F.get("v_plus", F.lit(i)) - F.get("v", F.lit(i)) for i in range(d)] + [F.get("h_plus", F.lit(i)) - F.get("h", F.lit(i)) for i in range(m)]
    of = {"v": z, "d": dz, "b": [F.get("bk", F.lit(i)) for i in range(k)]}
    per = both.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"), *[F.array(*[F.avg(p * q) for p in of[a] for q in of[b]]).alias(s) for s, (a, b) in BLOCKS.items()])
    return average_stats(per, list(STATS), {s: len(of[a]) * len(of[b]) for s, (a, b) in BLOCKS.items()}, [])


def score_complete(trans: DataFrame, hidden: DataFrame, model: StateModel) -> float:
    """Mean log-likelihood with known hidden trajectories."""
    row = complete_stats(trans, hidden, model.d, model.m, model.force.shape[1]).first()
    return log_likelihood(as_matrices(row, model.d, model.m, model.force.shape[1]), model.friction, model.force, model.noise, model.dt)
