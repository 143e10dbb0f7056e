"""Long trajectories over many tasks: ranges of rows, with the rows at their edges handed to neighbours."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Steps of a range, which one task orders and shifts.
RANGE = 1 << 17
#: Rows of a trajectory from which its rows are numbered by ranges.
LONG = 1 << 20
#: Rows of a table of trajectories that are broadcast; a larger one is joined by shuffles.
BROADCAST_ROWS = 100_000


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only local sessions without it get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/trajspark-scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: later jobs read it, also after executors are lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it has no more than BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Shifted:
    """Rows before and after those of trajectories, by their steps.

    Rows are dealt to ranges of RANGE steps, in one exchange. The first `ahead` rows of a range also
    stand in the range before it, and the last `behind` rows in the one after, so that no task holds
    more than a range of a trajectory. `own` tells a range's own rows from those handed over.
    """

    def __init__(self, df: DataFrame, ahead: int = 0, behind: int = 0):
        place, no = F.col("step") % RANGE, F.expr(f"step div {RANGE}")
        first = F.when((place < ahead) & (no > 0), no - 1).otherwise(no)
        last = F.when(place >= RANGE - behind, no + 1).otherwise(no)
        dealt = df.withColumns({"_no": no, "_range": F.explode(F.sequence(first, last))})
        self.rows = dealt.withColumn("_own", F.col("_no") == F.col("_range")).drop("_no")
        self.order = Window.partitionBy("traj_id", "_range").orderBy("step")

    def next(self, c: str, by: int = 1) -> Column:
        """c of the row whose step is `by` more; null if there is none."""
        return F.when(F.lead("step", by).over(self.order) == F.col("step") + by, F.lead(c, by).over(self.order))

    def previous(self, c: str, by: int = 1) -> Column:
        return F.when(F.lag("step", by).over(self.order) == F.col("step") - by, F.lag(c, by).over(self.order))

    @staticmethod
    def own(df: DataFrame) -> DataFrame:
        return df.where("_own").drop("_range", "_own")


def with_steps(df: DataFrame, order: list[str], time: str | None = None) -> DataFrame:
    """df with step, the place (from 0) of a row in its trajectory by the order columns, and _first,
    the column time of its first row.

    Trajectories of up to LONG rows are numbered by a window. Rows of longer ones are dealt to ranges
    of (traj_id, order), which are written; a row's step is its place in the range, plus the rows of
    the trajectory in ranges before. Rows that are equal in all order columns stand in any order.
    """
    keys = [F.col(c) for c in order]
    start = F.col(time) if time else F.lit(None)
    whole = Window.partitionBy("traj_id").orderBy(*keys)

    def by_window(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"step": (F.row_number().over(whole) - 1).cast("long"), "_first": F.first(start).over(whole)})

    lengths = df.groupBy("traj_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LONG).select(F.col("traj_id").alias("_long"))
    if lengths.isEmpty():
        return by_window(df)
    lengths = small(written(lengths))
    is_long = df["traj_id"].eqNullSafe(lengths["_long"])
    return by_window(df.join(lengths, is_long, "left_anti")).unionByName(by_ranges(df.join(lengths, is_long, "left_semi"), order, start))


def by_ranges(df: DataFrame, order: list[str], start: Column) -> DataFrame:
    """with_steps for trajectories of any length, all of them by ranges; start is the time's column."""
    columns, keys = df.columns, ["traj_id", *order]
    # equal rows may lie in several ranges
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie")
    at = F.monotonically_increasing_id()  # the range's number above 33 bits of the place in it
    dealt = written(dealt.withColumns({"_range": F.shiftrightunsigned(at, 33), "_place": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    found = dealt.groupBy("traj_id", "_range").agg(F.min("_place").alias("_least"), F.count(F.lit(1)).alias("_rows"), F.min_by(start, "_place").alias("_start"))
    ranges = Window.partitionBy("traj_id").orderBy("_range")
    before = F.coalesce(F.sum("_rows").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumns({"_before": before - F.col("_least"), "_first": F.first("_start").over(ranges)}).select(F.col("traj_id").alias("_id"), F.col("_range").alias("_r"), "_before", "_first")
    joined = dealt.join(small(written(found)), dealt["traj_id"].eqNullSafe(F.col("_id")) & (dealt["_range"] == F.col("_r")))
    return joined.withColumn("step", F.col("_place") + F.col("_before")).select(*columns, "step", "_first")
