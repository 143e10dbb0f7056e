"""Cutting, splitting and bootstrapping of trajectories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import ranges


def cut_trajectories(df: DataFrame, n_cut: int) -> DataFrame:
    """traj_id, piece, step (within the piece), t, x: n_cut pieces, the first T mod n_cut of which
    have one row more."""
    n = F.count(F.lit(1)).over(Window.partitionBy("traj_id"))
    sized = df.withColumn("_n", n).withColumns({"_q": F.expr(f"_n div {n_cut}"), "_r": F.col("_n") % n_cut})
    long_rows = F.col("_r") * (F.col("_q") + 1)
    early = F.col("step") < long_rows
    piece = F.when(early, F.expr("step div (_q + 1)")).otherwise(F.col("_r") + F.expr("(step - _r * (_q + 1)) div greatest(_q, 1)"))
    start = F.when(early, F.col("piece") * (F.col("_q") + 1)).otherwise(long_rows + (F.col("piece") - F.col("_r")) * F.col("_q"))
    return sized.withColumn("piece", piece.cast("long")).withColumn("step", (F.col("step") - start).cast("long")).select("traj_id", "piece", "step", "t", "x")


def _draw(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def shuffle_split(df: DataFrame, n_splits: int = 5, train_size: float = 0.9, seed: int = 0) -> DataFrame:
    """split_id, traj_id, role ('train' or 'test'): random subsets of trajectories in each split."""
    ids = df.select("traj_id").distinct()
    n = ids.count()
    draw = _draw(F.lit(str(seed)), F.col("split_id").cast("string"), F.col("traj_id").cast("string"))
    each = ids.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).withColumn("_d", draw).withColumn("_b", F.substring("_d", 1, 3))
    # ranks by parts of the draws' range, so that no task ranks all ids; there are 4,096 parts a split
    earlier = Window.partitionBy("split_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = each.groupBy("split_id", "_b").agg(F.count(F.lit(1)).alias("_c")).select("split_id", "_b", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("split_id", "_b").orderBy("_d", "traj_id"))
    ranked = each.withColumn("_r", within).join(F.broadcast(parts), ["split_id", "_b"])
    return ranked.select("split_id", "traj_id", F.when(F.col("_r") + F.col("_before") <= math.floor(train_size * n), "train").otherwise("test").alias("role"))


def numbered(df: DataFrame, by: str) -> tuple[DataFrame, int]:
    """by and _no, its place (from 0) in the order of a column without repeated values, and the number
    of rows. Up to LONG rows are numbered in one task, more by ranges that are written."""
    n = df.count()
    if n <= ranges.LONG:
        return df.select(by, (F.row_number().over(Window.orderBy(by)) - 1).cast("long").alias("_no")), n
    keyed = df.select(F.lit(0).alias("traj_id"), F.col(by).alias("_by"))
    return ranges.by_ranges(keyed, ["_by"], F.lit(None)).select(F.col("_by").alias(by), F.col("step").alias("_no")), n


def bootstrap_weights(df: DataFrame, n_splits: int = 5, train_size: float = 0.9, seed: int = 0) -> DataFrame:
    """split_id, traj_id, weight: how often draws with replacement took the trajectory."""
    ids, n = numbered(df.select("traj_id").distinct(), "traj_id")
    draws = df.sparkSession.range(n_splits * math.floor(train_size * n)).select(F.expr(f"cast(id div {math.floor(train_size * n) or 1} as int)").alias("split_id"), (F.col("id") % (math.floor(train_size * n) or 1)).alias("draw"))
    no = F.conv(F.substring(_draw(F.lit(str(seed)), F.col("split_id").cast("string"), F.col("draw").cast("string")), 1, 15), 16, 10).cast("long") % max(n, 1)
    return draws.withColumn("_no", no).join(ids, "_no").groupBy("split_id", "traj_id").agg(F.count(F.lit(1)).alias("weight"))
