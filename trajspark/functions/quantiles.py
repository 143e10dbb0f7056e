"""Exact quantiles without a sort and without all values in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ranges import with_steps, written

#: Bins of a counting pass, over all open intervals; values of an interval that reach the driver at last.
BINS, FEW = 8192, 4096


def exact_quantiles(df: DataFrame, values: list[Column], probabilities: list[float]) -> list[list[float]]:
    """For each of a few columns, its quantiles, linear between neighbours as percentile has them.

    Counting passes over bins narrow the intervals in which the wanted ranks lie, by the values that
    are there, until an interval holds one value or few. A pass sums counts before it shuffles them; the
    driver gets bins only. What is null or not a number doesn't count; without values, quantiles are not a number. Infinite values
    are an error.
    """
    named = df.select(*[F.when(~F.isnan(v), v.cast("double")).alias(f"v{i}") for i, v in enumerate(values)])
    ends = named.agg(*[f(f"v{i}") for i in range(len(values)) for f in (F.count, F.min, F.max)]).first()
    found: dict[tuple[int, int], float] = {}
    wanted, spans = [], {}
    for i in range(len(values)):
        n, low, high = ends[3 * i : 3 * i + 3]
        if n and math.inf in (-low, high):
            raise ValueError("quantiles of infinite values")
        wanted.append([p * (n - 1) for p in probabilities] if n else [])
        ranks = {int(r) for w in wanted[i] for r in (math.floor(w), math.ceil(w))}
        if n:
            spans[i, low, high] = (0, n, ranks)
    while spans:
        for (i, low, high), (_, _, ranks) in list(spans.items()):
            if low == high:
                found |= {(i, r): low for r in ranks}
                del spans[i, low, high]
        if not spans:
            break
        listed = sorted(spans)
        few = {s for s in listed if spans[s][1] <= FEW}
        width = max(2, BINS // len(listed))
        marks = []
        for j, (i, low, high) in enumerate(listed):
            v = F.col(f"v{i}")
            # halves, as the difference of two doubles may be none
            place = F.least(F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * width), F.lit(width - 1)).cast("long")
            key = F.struct(F.lit(j).alias("j"), (F.lit(None).cast("long") if (i, low, high) in few else place).alias("bin"), F.when(F.lit((i, low, high) in few), v).alias("v"))
            marks.append(F.when(v.between(low, high), F.struct(key.alias("key"), v.alias("value"))))
        each = named.select(F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m")).select("m.key.*", "m.value")
        counted: dict[int, list] = {}
        for r in each.groupBy("j", "bin", "v").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect():  # BINS rows, and FEW for each short interval
            counted.setdefault(r["j"], []).append((r["low"], r["high"], r["n"]))
        old, spans = spans, {}
        for j, span in enumerate(listed):
            before, _, ranks = old[span]
            for low, high, n in sorted(counted[j]):
                if here := {r for r in ranks if before <= r < before + n}:
                    spans[span[0], low, high] = (before, n, here)
                before += n
    return [[_between(found, i, w) for w in wanted[i]] if wanted[i] else [math.nan] * len(probabilities) for i in range(len(values))]


def _between(found: dict[tuple[int, int], float], i: int, rank: float) -> float:
    low, high = math.floor(rank), math.ceil(rank)
    if low == high:
        return found[i, low]
    return (high - rank) * found[i, low] + (rank - low) * found[i, high]


def grouped_quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """by, mean, and a column for each wanted quantile of a group, linear between neighbours.

    Values are numbered in each group by sorts that spill, a large group over many tasks, and only
    those of the wanted ranks go on: no task holds a group in memory. What is null or not a number
    doesn't count; a group without values has nulls.
    """
    # written, as it is read for counts, lengths and ranks
    rows = written(df.select(F.struct(*by).alias("traj_id"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v")))
    sums = rows.groupBy("traj_id").agg(F.avg("_v").alias("mean"), F.count("_v").alias("_n"))
    places = {name: p * (F.col("_n") - 1) for name, p in wanted.items()}
    share = lambda at: F.greatest(F.lit(0.0), 1 - F.abs(F.col("step") - at))
    needed = F.lit(False)
    for at in places.values():
        needed |= share(at) > 0
    ranked = with_steps(rows.where("_v is not null"), ["_v"]).select("traj_id", "step", "_v").join(sums.select("traj_id", "_n"), "traj_id").where(needed)
    found = ranked.groupBy("traj_id").agg(*[F.sum(F.when(share(at) > 0, F.col("_v") * share(at))).alias(name) for name, at in places.items()])
    return sums.join(found, "traj_id", "left").select("traj_id.*", "mean", *wanted)
