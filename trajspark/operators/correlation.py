"""Correlations of ordered series by lag, by Fourier transforms of trajectories."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import ranges

#: Steps up to which a trajectory is transformed as a whole, in one task; up to DIRECT its products are summed without a transform.
WHOLE, DIRECT = 1 << 20, 128
#: Numbers of a piece of a longer trajectory, which is transformed in pieces.
PIECE = 1 << 18
#: Rows of an Arrow batch of results, about.
ROWS = 200_000


def transform_size(n: int) -> int:
    """The power of two that keeps lags below n // 2 apart from those that wrap round."""
    return 1 << (n + n // 2 - 1).bit_length()


def lag_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of a_t * b_(t+k) for lags k below half the length."""
    n, lags = len(a), len(a) // 2
    if n <= DIRECT:
        return np.correlate(b, a, "full")[n - 1 : n - 1 + lags]
    size = transform_size(n)
    return np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)[:lags]


def series_correlation(step: np.ndarray, a: np.ndarray, b: np.ndarray, center: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of pairs by lag of one trajectory, in order of step; what is missing has no pairs."""
    n = int(step[-1] - step[0]) + 1
    whole = []
    for v in (a, b):
        there = np.isfinite(v)
        v = np.where(there, v - v[there].mean() if center and there.any() else v, 0.0)
        dense, mask = np.zeros(n), np.zeros(n)
        dense[step - step[0]], mask[step - step[0]] = v, there
        whole.append((dense, mask))
    (a, in_a), (b, in_b) = whole
    if in_a.all() and in_b.all():
        return lag_sums(a, b), n - np.arange(n // 2)
    return lag_sums(a, b), np.rint(lag_sums(in_a, in_b)).astype(np.int64)


def _whole(center: bool):
    """Correlations of trajectories that come one after another in order of step."""

    def emit(batches):
        open_id, parts, out, held = None, [], [], 0

        def close():
            step, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            sums, pairs = series_correlation(step, a, b, center)
            return open_id, np.arange(len(sums)), sums, pairs

        def rows(kind):
            ids, lag, s, n = zip(*out, strict=True)
            named = pa.array([i for i, x in zip(ids, lag, strict=True) for _ in x], kind)
            return pa.RecordBatch.from_arrays([named, *(pa.array(np.concatenate(x)) for x in (lag, s, n))], ["traj_id", "lag", "s", "pairs"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("traj_id").type
            runs = pc.run_end_encode(batch.column("traj_id"))
            step, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("step", "a", "b"))
            start = 0
            for traj_id, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if parts and traj_id != open_id:
                    out.append(close())
                    held, parts = held + len(out[-1][1]), []
                open_id = traj_id
                parts.append((step[start:end], a[start:end], b[start:end]))
                start = end
            if held > ROWS:
                yield rows(kind)
                out, held = [], 0
        if parts:
            out.append(close())
        if out:
            yield rows(kind)

    return emit


class Grid:
    """A transform of length rows * cols in two steps: over the rows of each column, then, turned by a
    phase, over the columns of each row. Columns and rows stand in blocks of `piece` numbers, about."""

    def __init__(self, n: int, piece: int):
        size = transform_size(n)
        self.rows = 1 << (size.bit_length() - 1) // 2
        self.cols = size // self.rows
        self.width, self.height = max(1, min(self.cols, piece // self.rows)), max(1, min(self.rows, piece // self.cols))

    def phase(self, row: int, col: int, shape: tuple[int, int]) -> np.ndarray:
        turns = np.outer(row + np.arange(shape[0]), col + np.arange(shape[1]))
        return np.exp(-2j * np.pi * turns / (self.rows * self.cols))

    def col_blocks(self) -> range:
        return range(0, self.cols, self.width)

    def row_blocks(self) -> range:
        return range(0, self.rows, self.height)


PIECES = "n long, holes boolean, row_at int, col_at int, data binary"


def _table(kind: pa.DataType, traj_id, n: int, holes: bool, pieces: list[tuple[int, int, np.ndarray]]) -> pa.Table:
    rows, cols, data = zip(*pieces, strict=True)
    m = len(rows)
    return pa.table({"traj_id": pa.array([traj_id] * m, kind), "n": pa.array([n] * m), "holes": pa.array([holes] * m), "row_at": pa.array(rows, pa.int32()), "col_at": pa.array(cols, pa.int32()), "data": pa.array([np.ascontiguousarray(d).tobytes() for d in data], pa.binary())})


def _columns(key: tuple, table: pa.Table, piece: int) -> pa.Table:
    """First step forward: a block of columns is transformed over the rows, and cut to blocks of rows."""
    n, holes, col = table["n"][0].as_py(), table["holes"][0].as_py(), key[1].as_py()
    grid = Grid(n, piece)
    row, at = np.divmod(table["place"].to_numpy(), grid.cols)
    channels = []
    for c in ("a", "b"):
        v = table[c].to_numpy()
        there = np.isfinite(v)
        for x in (np.where(there, v, 0.0), there)[: 1 + holes]:
            channels.append(np.zeros((grid.rows, grid.width)))
            channels[-1][row, at - col] = x
    turned = np.fft.fft(np.stack(channels), axis=1) * grid.phase(0, col, (grid.rows, grid.width))
    return _table(table.schema.field("traj_id").type, key[0].as_py(), n, holes, [(r, col, turned[:, r : r + grid.height]) for r in grid.row_blocks()])


def _rows(key: tuple, table: pa.Table, piece: int) -> pa.Table:
    """Second step forward, the product of both series, and the first step back, over the columns."""
    n, holes, row = table["n"][0].as_py(), table["holes"][0].as_py(), key[1].as_py()
    grid = Grid(n, piece)
    whole = np.empty((2 + 2 * holes, grid.height, grid.cols), complex)
    for col, data in zip(table["col_at"].to_pylist(), table["data"], strict=True):
        whole[:, :, col : col + grid.width] = np.frombuffer(data.as_buffer(), complex).reshape(len(whole), grid.height, grid.width)
    spectra = np.fft.fft(whole, axis=2)
    half = 1 + holes
    back = np.fft.ifft(np.conj(spectra[:half]) * spectra[half:], axis=2) * np.conj(grid.phase(row, 0, (grid.height, grid.cols)))
    return _table(table.schema.field("traj_id").type, key[0].as_py(), n, holes, [(row, c, back[:, :, c : c + grid.width]) for c in grid.col_blocks()])


def _lags(key: tuple, table: pa.Table, piece: int) -> pa.Table:
    """Second step back, over the rows of a block of columns: sums and pairs by lag."""
    n, holes, col = table["n"][0].as_py(), table["holes"][0].as_py(), key[1].as_py()
    grid = Grid(n, piece)
    whole = np.empty((1 + holes, grid.rows, grid.width), complex)
    for row, data in zip(table["row_at"].to_pylist(), table["data"], strict=True):
        whole[:, row : row + grid.height] = np.frombuffer(data.as_buffer(), complex).reshape(len(whole), grid.height, grid.width)
    sums = np.fft.ifft(whole, axis=1).real
    lag = np.arange(grid.rows)[:, None] * grid.cols + col + np.arange(grid.width)
    kept = lag < n // 2
    lag = lag[kept]
    pairs = np.rint(sums[1][kept]).astype(np.int64) if holes else n - lag
    return pa.table({"traj_id": pa.array([key[0].as_py()] * len(lag), table.schema.field("traj_id").type), "lag": pa.array(lag), "s": pa.array(sums[0][kept]), "pairs": pa.array(pairs)})


def _in_pieces(rows: DataFrame, kind: str, piece: int) -> DataFrame:
    """traj_id, lag, s, pairs of long trajectories (traj_id, place, a, b, n, holes)."""
    # as Grid has it: rows, then the width of a block of columns
    power = F.length(F.bin(F.expr("n + n div 2 - 1")))
    down, across = (F.expr(f"shiftleft(1L, cast({p} as int))") for p in ("_p div 2", "_p - _p div 2"))
    width = F.greatest(F.lit(1), F.least("_cols", F.expr(f"{piece} div _rows")))
    placed = rows.withColumn("_p", power).withColumns({"_rows": down, "_cols": across}).withColumn("_w", width)
    placed = placed.withColumn("col_at", (F.expr("(place % _cols) div _w") * F.col("_w")).cast("int")).drop("_p", "_rows", "_cols", "_w")
    shape = f"traj_id {kind}, {PIECES}"
    by_rows = placed.groupBy("traj_id", "col_at").applyInArrow(lambda key, table: _columns(key, table, piece), shape)
    by_cols = by_rows.groupBy("traj_id", "row_at").applyInArrow(lambda key, table: _rows(key, table, piece), shape)
    return by_cols.groupBy("traj_id", "col_at").applyInArrow(lambda key, table: _lags(key, table, piece), f"traj_id {kind}, lag long, s double, pairs long")


def correlation(df: DataFrame, a: str, b: str | None = None, subtract_mean: bool = False, max_lag: int | None = None, whole: int = WHOLE, piece: int = PIECE) -> DataFrame:
    """traj_id, lag, value: unbiased c(k), the mean of a_t * b_(t+k) over the pairs of a trajectory, for
    k < N // 2 (and k <= max_lag, if given), where N are the steps from its first to its last row.

    df: traj_id, step and scalar columns a and b. A value that is null or not finite, and a step that
    has no row, is missing: pairs with it count neither in the sum nor in their number; a lag without
    pairs is null. Trajectories of up to `whole` steps come sorted to one task, each is one transform.
    Longer ones are transformed in two steps over many tasks, which hold a block of columns or rows of
    `piece` numbers each, so cost grows as n log n and memory does not.
    """
    rows = df.select("traj_id", F.col("step").cast("long").alias("step"), F.col(a).cast("double").alias("a"), F.col(b or a).cast("double").alias("b"))
    kind = rows.schema["traj_id"].dataType.simpleString()
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))  # noqa: E731  NaN is greater
    lengths = rows.groupBy("traj_id").agg(F.min("step").alias("_low"), (F.max("step") - F.min("step") + 1).alias("n"), F.count(finite("a") + finite("b")).alias("_both"), F.avg(finite("a")).alias("_a"), F.avg(finite("b")).alias("_b"))
    long = lengths.where(F.col("n") > whole)
    found, rest = None, rows
    if not long.isEmpty():
        long = ranges.small(ranges.written(long.withColumnRenamed("traj_id", "_id")))
        same = rows["traj_id"].eqNullSafe(long["_id"])
        rest = rows.join(long, same, "left_anti")
        less = lambda c: (F.col(c) - F.col(f"_{c}") if subtract_mean else F.col(c)).alias(c)
        pieces = rows.join(long, same).select("traj_id", (F.col("step") - F.col("_low")).alias("place"), *(F.coalesce(less(c), F.lit(float("nan"))).alias(c) for c in ("a", "b")), "n", (F.col("_both") < F.col("n")).alias("holes"))
        found = _in_pieces(pieces, kind, piece)
    sorted_rows = rest.repartition("traj_id").sortWithinPartitions("traj_id", "step")
    out = sorted_rows.mapInArrow(_whole(subtract_mean), f"traj_id {kind}, lag long, s double, pairs long")
    out = out if found is None else out.unionByName(found)
    out = out if max_lag is None else out.where(F.col("lag") <= max_lag)
    return out.select("traj_id", "lag", F.when(F.col("pairs") > 0, F.col("s") / F.col("pairs")).alias("value"))


def vacf(df: DataFrame, column: str, max_lag: int | None = None) -> DataFrame:
    """lag, value: correlations summed over trajectories, by that of lag 0."""
    sums = correlation(df, column, max_lag=max_lag).groupBy("lag").agg(F.sum("value").alias("s"))
    square = F.when(F.abs(column) < float("inf"), F.col(column) * F.col(column))
    squares = df.groupBy("traj_id").agg(F.avg(square).alias("z"), (F.max("step") - F.min("step")).alias("_span")).where("_span > 0")
    return sums.select("lag", (F.col("s") / squares.agg(F.sum("z")).scalar()).alias("value"))
