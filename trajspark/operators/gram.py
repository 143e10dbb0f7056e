"""Gram matrices of rows by partial sums of Arrow batches: bases of any size, dense or sparse."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ranges import written

#: Rows that are multiplied at once, and entries of sparse sums that are held before they are added up.
ROWS, HELD = 4096, 2_000_000
#: Parts of the Gram matrix of (v, dv, b) that make the statistics.
PARTS = {"xx": "vv", "xdx": "vd", "dxdx": "dd", "bkx": "bv", "bkdx": "bd", "bkbk": "bb"}


class _Sums:
    """The Gram matrix of one key: the whole matrix, or its entries that are not zero."""

    def __init__(self, size: int, sparse: bool):
        self.size, self.n, self.held = size, 0, 0
        self.whole = None if sparse else np.zeros((size, size))
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add_dense(self, z: np.ndarray) -> None:
        self.n += len(z)
        for at in range(0, len(z), ROWS):
            part = z[at : at + ROWS]
            self.whole += part.T @ part

    def add_sparse(self, index: np.ndarray, value: np.ndarray) -> None:
        """index, value: (rows, live) elements of each row; others are zero."""
        self.n += len(index)
        for at in range(0, len(index), ROWS):
            i, v = index[at : at + ROWS], value[at : at + ROWS]
            a, b = np.broadcast_arrays(i[:, :, None], i[:, None, :])
            keep = (a <= b) & ((v[:, :, None] != 0) & (v[:, None, :] != 0))
            product = v[:, :, None] * v[:, None, :]
            self.parts.append(_summed(a[keep] * self.size + b[keep], product[keep]))
            self.held += len(self.parts[-1][0])
            if self.held > HELD:
                self._add_up()

    def _add_up(self) -> None:
        self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))] if self.parts else []
        self.held = sum(len(x[0]) for x in self.parts)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Places i * size + j with i <= j, and sums; place -1 has the number of rows."""
        if self.whole is not None:
            upper = np.triu(self.whole).ravel()
            at = np.flatnonzero(upper)
            s = upper[at]
        else:
            self._add_up()
            at, s = self.parts[0] if self.parts else (np.empty(0, np.int64), np.empty(0))
        return np.r_[-1, at], np.r_[float(self.n), s]


def _summed(at: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(at, return_inverse=True)
    return found, np.bincount(inverse, weights=s, minlength=len(found))


def _dense(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sparse(column: pa.Array, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements of a row as (index, value): the dense ones first, then those of the list of (i, value)."""
    n, d = dense.shape
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(int)
    live = int(length.max(initial=0))
    index, value = np.zeros((n, d + live), np.int64), np.zeros((n, d + live))
    index[:, :d], value[:, :d] = np.arange(d), dense
    flat = column.flatten()
    row = np.repeat(np.arange(n), length)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    index[row, d + place] = d + flat.field("i").to_numpy(zero_copy_only=False)
    value[row, d + place] = flat.field("value").to_numpy(zero_copy_only=False)
    return index, value


def gram_rows(df: DataFrame, key: str, dense: str, width: int, basis: str, n_basis: int) -> DataFrame:
    """key, at, s: sums of products of the elements (dense, then basis) of a key's rows, by place i * size
    + j with i <= j; zeros are left out, place -1 has the number of rows.

    basis is an array of doubles, or of (i, value) with the elements that are not zero, each once. Runs
    of rows of one key are summed in a task; the few partial sums of a key meet by place.
    """
    sparse = "struct" in dict(df.dtypes)[basis]
    size, kind = width + n_basis, dict(df.dtypes)[key]

    def partial(batches):
        now, sums, out = None, None, []

        def flush():
            ids, entries = zip(*out, strict=True)
            at, s = (np.concatenate(x) for x in zip(*entries, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([i for i, e in zip(ids, entries, strict=True) for _ in e[0]], arrow), pa.array(at), pa.array(s)], [key, "at", "s"])

        arrow = None
        for batch in batches:
            arrow = batch.schema.field(key).type
            left = _dense(batch.column("_dense"), width)
            parts = _sparse(batch.column("_basis"), left) if sparse else (np.concatenate([left, _dense(batch.column("_basis"), n_basis)], axis=1),)
            runs = pc.run_end_encode(batch.column(key))
            start = 0
            for k, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if sums is not None and k != now:
                    out.append((now, sums.entries()))
                    sums = None
                    if sum(len(e[1][0]) for e in out) > HELD // 10:
                        yield flush()
                        out = []
                now, sums = k, sums or _Sums(size, sparse)
                (sums.add_sparse if sparse else sums.add_dense)(*(p[start:end] for p in parts))
                start = end
        if sums is not None:
            out.append((now, sums.entries()))
        if out:
            yield flush()

    picked = df.select(key, F.col(dense).alias("_dense"), F.col(basis).alias("_basis"))
    return picked.mapInArrow(partial, f"{key} {kind}, at long, s double").groupBy(key, "at").agg(F.sum("s").alias("s"))


def _as_stats(keys: list[str], dim_x: int, n_basis: int):
    """One row of statistics of a key's places; what is missing is zero."""
    size = 2 * dim_x + n_basis
    of = {"v": slice(0, dim_x), "d": slice(dim_x, 2 * dim_x), "b": slice(2 * dim_x, size)}

    def build(key: tuple, table: pa.Table) -> pa.Table:
        at, s = table.column("at").to_numpy(), table.column("s").to_numpy()
        g = np.zeros(size * size)
        g[at] = s
        g = g.reshape(size, size)
        g = g + np.triu(g, 1).T
        named = {k: pa.array([v.as_py()], table.schema.field(k).type) for k, v in zip(keys, key, strict=True)}
        named["n"] = pa.array([table.column("n")[0].as_py()], pa.int64())
        return pa.table(named | {name: pa.array([g[of[a], of[b]].ravel()], pa.list_(pa.float64())) for name, (a, b) in PARTS.items()})

    return build


def _stats_table(sums: DataFrame, keys: list[str], dim_x: int, n_basis: int) -> DataFrame:
    """keys, n and array statistics of sums (keys, n, at, s): a group has the places of one matrix."""
    kinds = dict(sums.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "n long, " + ", ".join(f"{s} array<double>" for s in PARTS)
    if keys:
        return sums.groupBy(*keys).applyInArrow(_as_stats(keys, dim_x, n_basis), schema)
    build = _as_stats(["_one"], dim_x, n_basis)
    return sums.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(build, "_one int, " + schema).drop("_one")


def _of_transitions(trans: DataFrame, dim_x: int, n_basis: int) -> DataFrame:
    moved = trans.withColumn("_vd", F.concat("v", F.zip_with("v_plus", "v", lambda a, b: a - b)))
    return gram_rows(moved, "traj_id", "_vd", 2 * dim_x, "bk", n_basis)


def gram_trajectory_stats(trans: DataFrame, dim_x: int, n_basis: int) -> DataFrame:
    """The same as trajectory_stats, by partial Gram matrices; bk may be sparse."""
    sums = written(_of_transitions(trans, dim_x, n_basis))
    counts = sums.where("at = -1").select("traj_id", F.col("s").cast("long").alias("n"))
    means = sums.where("at >= 0").join(counts, "traj_id").withColumn("s", F.col("s") / F.col("n"))
    return _stats_table(means, ["traj_id"], dim_x, n_basis)


def gram_visible_stats(trans: DataFrame, dim_x: int, n_basis: int, weights: DataFrame | None = None, weight: str = "trajectory") -> DataFrame:
    """The same as visible_stats, by partial Gram matrices; bk may be sparse. Places are averaged over
    trajectories as rows, so no trajectory's matrix is ever an array."""
    sums = written(_of_transitions(trans, dim_x, n_basis))
    counts = sums.where("at = -1").select("traj_id", F.col("s").cast("long").alias("n"))
    counts, keys = (counts.join(weights, "traj_id"), ["split_id"]) if weights is not None else (counts, [])
    times = F.col("weight") if weights is not None else F.lit(1)
    counts = counts.withColumns({"_w": (times * (F.col("n") if weight == "transition" else F.lit(1))).cast("double"), "_times": times})
    total = counts.groupBy(*keys).agg(F.sum("_w").alias("_total"), F.sum(F.col("n") * F.col("_times")).cast("long").alias("n"))
    means = sums.where("at >= 0").join(counts.withColumnRenamed("n", "_n"), "traj_id").groupBy(*keys, "at").agg(F.sum(F.col("s") / F.col("_n") * F.col("_w")).alias("s"))
    # a row a split
    met = means.join(F.broadcast(total), keys) if keys else means.join(F.broadcast(total))
    return _stats_table(met.withColumn("s", F.col("s") / F.col("_total")), keys, dim_x, n_basis)


def gram_matrix(df: DataFrame, dense: str, width: int, basis: str, n_basis: int) -> tuple[np.ndarray, float]:
    """The Gram matrix of all rows, and their number: the driver gets one matrix."""
    size = width + n_basis
    g, n = np.zeros(size * size), 0.0
    for r in gram_rows(df.withColumn("_one", F.lit(0)), "_one", dense, width, basis, n_basis).toLocalIterator():
        if r["at"] < 0:
            n = r["s"]
        else:
            g[r["at"]] = r["s"]
    g = g.reshape(size, size)
    return g + np.triu(g, 1).T, n
