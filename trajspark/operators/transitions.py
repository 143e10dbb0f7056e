"""Transitions of trajectories and their second moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ranges import Shifted
from .gram import PARTS, gram_trajectory_stats, gram_visible_stats


def transitions(df: DataFrame, basis, dt: float = 1.0, sparse: bool = False) -> DataFrame:
    """traj_id, step, x, v, v_plus, bk: v = (x_next - x) / dt; a trajectory of T rows has T - 2. With
    sparse, bk has the basis elements that are not zero as (i, value), which visible statistics and
    Markov fits take as they are.

    One exchange, by trajectory and range of steps: a long trajectory is spread over tasks, and two rows
    at the start of a range are handed to the one before. Steps count up by one; there is no transition
    over a missing step.
    """
    near = Shifted(df.select("traj_id", "step", "x"), ahead=2)
    moved = near.rows.withColumn("v", F.zip_with(near.next("x"), "x", lambda a, b: (a - b) / dt))
    return basis.attach(near.own(moved.withColumn("v_plus", near.next("v")).where("v_plus is not null")), "bk", sparse)


BLOCKS = PARTS
#: Products of a row up to which statistics are aggregates of a column each.
COLUMNS = 200


def _elements(dim_x: int, n_basis: int, name: str) -> list[tuple[Column, Column]]:
    of = {"v": [F.get("v", F.lit(i)) for i in range(dim_x)], "d": [F.get("v_plus", F.lit(i)) - F.get("v", F.lit(i)) for i in range(dim_x)], "b": [F.get("bk", F.lit(i)) for i in range(n_basis)]}
    a, b = BLOCKS[name]
    return [(p, q) for p in of[a] for q in of[b]]


def _large(trans: DataFrame, dim_x: int, n_basis: int) -> bool:
    return "struct" in dict(trans.dtypes)["bk"] or sum(sizes(dim_x, n_basis).values()) > COLUMNS


def trajectory_stats(trans: DataFrame, dim_x: int, n_basis: int) -> DataFrame:
    """traj_id, n and the mean products xx, xdx, dxdx, bkx, bkdx, bkbk (row-major) of each trajectory.
    Of large or sparse bases, they come from partial Gram matrices."""
    if _large(trans, dim_x, n_basis):
        return gram_trajectory_stats(trans, dim_x, n_basis)
    return trans.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"), *[F.array(*[F.avg(p * q) for p, q in _elements(dim_x, n_basis, s)]).alias(s) for s in BLOCKS])


def average_stats(per_traj: DataFrame, names: list[str], sizes: dict[str, int], by: list[str], weights: DataFrame | None = None, weight: str = "trajectory") -> DataFrame:
    """Means of array statistics over trajectories, each the same weight, or its number of
    transitions; times the weights of a bootstrap (split_id, traj_id, weight) if given. Statistics that have a
    split_id themselves meet the weights of that split only."""
    keys = list(by)
    if weights is not None:
        own = ["traj_id", "split_id"] if "split_id" in per_traj.columns else ["traj_id"]
        per_traj, keys = per_traj.join(weights, own), [*keys, "split_id"]
    w = (F.col("weight") if weights is not None else F.lit(1)) * (F.col("n") if weight == "transition" else F.lit(1))
    marked = per_traj.withColumn("_w", w.cast("double"))
    if sum(sizes[s] for s in names) > COLUMNS:
        return sums_by_place(marked, names, sizes, keys, F.col("n") * (F.col("weight") if weights is not None else F.lit(1)), mean=True)
    mean = lambda c: F.sum(c * F.col("_w")) / F.sum("_w")
    return marked.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("weight") if weights is not None else F.lit(1))).cast("long").alias("n"), *[F.array(*[mean(F.get(s, F.lit(i))) for i in range(sizes[s])]).alias(s) for s in names])


def sums_by_place(marked: DataFrame, names: list[str], sizes: dict[str, int], keys: list[str], n: Column, mean: bool = False) -> DataFrame:
    """keys, n and the sums (or means) of long arrays weighted by _w, a row an element, put together as arrays again."""
    totals = marked.groupBy(*keys).agg(F.sum(n).cast("long").alias("n"), F.sum("_w").alias("_total"))
    places = marked.select(*keys, "_w", F.posexplode(F.concat(*names)).alias("_at", "_s")).groupBy(*keys, "_at").agg(F.sum(F.col("_s") * F.col("_w")).alias("_s"))
    whole = places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_s"))), lambda r: r["_s"]).alias("_all"))
    met = whole.join(totals, keys) if keys else whole.join(F.broadcast(totals))
    start, cut = 1, {}
    for s in names:
        part = F.slice("_all", start, sizes[s])
        cut[s], start = F.transform(part, lambda v: v / F.col("_total")) if mean else part, start + sizes[s]
    return met.select(*keys, "n", *[c.alias(s) for s, c in cut.items()])


def sizes(dim_x: int, n_basis: int) -> dict[str, int]:
    of = {"v": dim_x, "d": dim_x, "b": n_basis}
    return {s: of[a] * of[b] for s, (a, b) in BLOCKS.items()}


def visible_stats(trans: DataFrame, dim_x: int, n_basis: int, weights: DataFrame | None = None, weight: str = "trajectory") -> DataFrame:
    """One row of statistics (one a split_id if weights are given)."""
    if _large(trans, dim_x, n_basis):
        return gram_visible_stats(trans, dim_x, n_basis, weights, weight)
    return average_stats(trajectory_stats(trans, dim_x, n_basis), list(BLOCKS), sizes(dim_x, n_basis), [], weights, weight)
