"""Trajectories as tables: traj_id, step BIGINT, t DOUBLE, x ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import Shifted, with_steps


def read_trajectories(spark: SparkSession, paths: str | list[str], dim_x: int, max_length: int | None = None, bad_rows: str = "raise", named: bool = False) -> DataFrame:
    """Text files of one trajectory each: white-space columns t x_1 .. x_d, # comments. Time starts
    at the first row's; only the first max_length rows count.

    With named, a column before these has the trajectory's name, which is its traj_id: files hold rows
    of any trajectories then, so that many short ones need no file each.

    Rows are in order of time, and those of one time in order of their text. A row with fewer columns,
    or with a time or value that is no number (nan and infinities are numbers; a nan time is bad), is
    bad: by "raise" reading it is an error that shows the row, by "drop" it is left out and the other
    rows count. Further columns are ignored. See count_bad_rows.
    """
    if bad_rows not in ("raise", "drop"):
        raise ValueError(f"bad_rows is raise or drop, not {bad_rows}")
    rows = _cells(spark, paths, dim_x, named)
    if bad_rows == "raise":
        told = F.raise_error(F.concat(F.lit("bad row in "), "traj_id", F.lit(": "), "line"))
        rows = rows.withColumn("t", F.when(F.col("bad"), told.cast("double")).otherwise(F.col("t")))
    else:
        rows = rows.where(~F.col("bad"))
    out = with_steps(rows.select("traj_id", "t", "x", "line"), ["t", "line"], "t").select("traj_id", "step", (F.col("t") - F.col("_first")).alias("t"), "x")
    return out if max_length is None else out.where(F.col("step") < max_length)


def _cells(spark: SparkSession, paths: str | list[str], dim_x: int, named: bool) -> DataFrame:
    """traj_id, line, t, x, bad of the rows of text files."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("traj_id"), F.trim(F.regexp_replace("value", r"#.*|\s", " ")).alias("line"))
    lines = lines.where("line <> ''").withColumn("_parts", F.split("line", r"\s+"))
    if named:
        lines = lines.withColumns({"traj_id": F.get("_parts", F.lit(0)), "_parts": F.slice("_parts", 2, dim_x + 1)})
    cells = lines.withColumn("c", F.slice(F.transform("_parts", lambda c: c.try_cast("double")), 1, dim_x + 1))
    bad = (F.size("c") <= dim_x) | F.exists("c", lambda c: c.isNull()) | F.isnan(F.get("c", F.lit(0)))
    return cells.select("traj_id", "line", F.get("c", F.lit(0)).alias("t"), F.slice("c", 2, dim_x).alias("x"), bad.alias("bad"))


def count_bad_rows(spark: SparkSession, paths: str | list[str], dim_x: int, named: bool = False) -> DataFrame:
    """traj_id, n_rows, n_bad, example (a bad row) of text files, as read_trajectories would read them."""
    rows = _cells(spark, paths, dim_x, named)
    return rows.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("bad").alias("n_bad"), F.min(F.when(F.col("bad"), F.col("line"))).alias("example"))


def as_trajectories(df: DataFrame, id: str, order_by: list[str], values: list[Column], dt: float | None = None, time: Column | None = None) -> DataFrame:
    """Any table as trajectories: its id, order and value columns. The time is the given one, less the
    trajectory's first, or else step * dt. Rows of a null id are one trajectory; nulls come first."""
    named = df.select(F.col(id).alias("traj_id"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)], F.array(*[v.cast("double") for v in values]).alias("x"), *([time.cast("double").alias("_t")] if time is not None else []))
    rows = with_steps(named, [f"_o{i}" for i in range(len(order_by))], "_t" if time is not None else None)
    t = F.col("_t") - F.col("_first") if time is not None else F.col("step") * F.lit(float(dt or 1.0))
    return rows.select("traj_id", "step", t.cast("double").alias("t"), "x")


def trajectory_summary(df: DataFrame) -> DataFrame:
    """traj_id, n, dt (first step), min_dt, max_dt, n_bad (values that are null, NaN or infinite)."""
    near = Shifted(df, ahead=1)
    bad = F.size(F.filter("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return (
        near.own(near.rows.withColumns({"_gap": near.next("t") - F.col("t"), "_bad": bad}))
        .groupBy("traj_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("_gap", "step").alias("dt"), F.min("_gap").alias("min_dt"), F.max("_gap").alias("max_dt"), F.sum("_bad").alias("n_bad"))
    )


def validate(df: DataFrame, tolerance: float = 1e-6) -> float:
    """The common time step; ValueError for short trajectories, values that are no numbers, and
    steps that are not positive or not constant."""
    s = trajectory_summary(df).agg(F.min("n"), F.sum("n_bad"), F.min("min_dt"), F.max("max_dt"), F.first("dt")).first()
    if s[0] is None or s[0] < 4:
        raise ValueError("trajectories need at least 4 rows")
    if s[1]:
        raise ValueError(f"{s[1]} values are not finite")
    if s[2] <= 0 or s[3] - s[2] > tolerance * s[3]:
        raise ValueError("the time step is not positive and constant")
    return s[4]


def with_gradient_velocity(df: DataFrame) -> DataFrame:
    """v: second-order differences on irregular times, one-sided at both ends and beside missing steps."""
    near = Shifted(df, ahead=1, behind=1)
    parts = near.own(near.rows.withColumns({"_hs": F.col("t") - near.previous("t"), "_hd": near.next("t") - F.col("t"), "_xs": near.previous("x"), "_xd": near.next("x")}))
    hs, hd = F.col("_hs"), F.col("_hd")
    rise = F.zip_with("x", "_xs", lambda a, b: (a - b) / hs)
    fall = F.zip_with("_xd", "x", lambda a, b: (a - b) / hd)
    inner = F.zip_with(F.arrays_zip("_xs", "_xd"), "x", lambda s, x: (hs * hs * s["_xd"] + (hd * hd - hs * hs) * x - hd * hd * s["_xs"]) / (hs * hd * (hd + hs)))
    v = F.when(hs.isNull(), fall).when(hd.isNull(), rise).otherwise(inner)
    return parts.withColumn("v", v).drop("_hs", "_hd", "_xs", "_xd")
