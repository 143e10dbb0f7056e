"""SimHash near duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise
from .jaccard_join import connected_components

WORDS, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a tile, about; and of the runs of a tile that are compared at once.
TILE, RUN = 16_384, 256
#: Shingles hashed at once.
CHUNK = 1 << 16
#: Whether a byte has each of its bits.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """Signed 64-bit SimHash of a text: a bit is 1 if it is set in over half the XXH64 of its n-word shingles."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    k = min(n, len(found))
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(islice(found, i, None) for i in range(k)), strict=False)), repeat(SEED))
    total, left = np.zeros((8, 8), np.int64), len(found) - k + 1
    for m in (min(CHUNK, left - i) for i in range(0, left, CHUNK)):
        octets = np.fromiter(hashes, "<u8", m).view(np.uint8).reshape(-1, 8)
        total += np.bincount((octets + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits(2 * total > left, bitorder="little").view("<i8")[0])


def _fingerprints(n: int):
    def emit(batches):
        for batch in batches:
            found = pa.array([fingerprint(x, n) for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fp"])

    return emit


class _Forest:
    """Joins numbers 0 .. n - 1 to sets, each named by its least."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up

    def one(self, rows: np.ndarray) -> bool:
        return bool((self.root[rows] == self.root[rows[0]]).all())


def _runs(tile: np.ndarray):
    """The tile ordered by the population counts of its bytes, its runs, and each run's least and most counts."""
    counts = np.bitwise_count(tile.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    order = np.lexsort((*counts.T[::2], *counts.reshape(-1, 4, 2).sum(axis=2).T))
    tile, counts = tile[order], counts[order]
    starts = np.arange(0, len(tile), RUN)
    return tile, starts, np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)


def linked(one: np.ndarray, two: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within radius between two tiles (or in one, if two is None), as pairs of
    fingerprints: at most as many pairs as fingerprints, joining what the links join.

    Runs of fingerprints are compared by exclusive-or and bit counts; pairs of runs whose bytes'
    population counts differ by more than radius in sum hold no link and are skipped.
    """
    a, a_starts, a_low, a_high = _runs(one)
    b, b_starts, b_low, b_high = (a, a_starts, a_low, a_high) if two is None else _runs(two)
    shift = 0 if two is None else len(a)
    every = a if two is None else np.concatenate([a, b])
    forest = _Forest(len(every))
    for i, start in enumerate(a_starts):
        first = i if two is None else 0
        gap = np.maximum(0, np.maximum(a_low[i] - b_high[first:], b_low[first:] - a_high[i])).sum(axis=1)
        mine = a[start : start + RUN]
        for at in b_starts[first:][gap <= radius]:
            theirs = b[at : at + RUN]
            if forest.one(np.r_[start : start + len(mine), shift + at : shift + at + len(theirs)]):
                continue
            x, y = np.nonzero(np.bitwise_count(mine[:, None] ^ theirs[None, :]) <= radius)
            forest.join(start + x, shift + at + y)
    below = np.flatnonzero(forest.root != np.arange(len(every)))
    return every[below], every[forest.root[below]]


def _compare(radius: int):
    def links(table: pa.Table) -> pa.Table:
        sides = {side: np.asarray(fps.values).view("<u8") for side, fps in zip(table.column("side").to_pylist(), table.column("fps").combine_chunks(), strict=True)}
        a, b = linked(sides[0], sides.get(1), radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return links


def _tile_pairs(groups: DataFrame, radius: int) -> DataFrame:
    """a, b, side, fps: each pair of tiles whose fingerprints may link, as one row a side.

    A tile holds fingerprints of equal population counts of both halves, at most about TILE of them. Two
    tiles are a pair if these counts differ by no more than radius in sum.
    """
    half = lambda c: F.bit_count(c).cast("int")
    placed = groups.select("fp", half(F.shiftrightunsigned("fp", 32)).alias("p"), half(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("q"))
    # 33 x 33 rows at most
    cells = materialise(placed.groupBy("p", "q").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks")))
    tiles = placed.join(F.broadcast(cells), ["p", "q"]).withColumn("no", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    tiles = materialise(tiles.groupBy("p", "q", "no").agg(F.collect_list("fp").alias("fps")))
    near = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]
    moves = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near)))
    other = cells.select(F.col("p").alias("p2"), F.col("q").alias("q2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("no2"))
    other = other.groupBy("p2", "q2").agg(F.collect_list("no2").alias("others"))
    met = tiles.withColumn("move", moves).withColumns({"p2": F.col("p") + F.col("move.i"), "q2": F.col("q") + F.col("move.j")}).join(F.broadcast(other), ["p2", "q2"])
    met = met.withColumn("no2", F.explode("others"))
    name = lambda p, q, no: (F.col(p) * 33 + F.col(q)).cast("long") * F.lit(1 << 40) + F.col(no)
    met = met.select(name("p", "q", "no").alias("own"), name("p2", "q2", "no2").alias("other"), "fps")
    return met.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fps")


def simhash_components(docs: DataFrame, n: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose SimHash fingerprints are linked by radius or fewer differing bits.

    Equal fingerprints are one. Distinct ones stand in tiles by the population counts of their halves,
    and every pair of tiles whose counts allow a link is compared in a group of its own, by numpy; in
    it, pairs of runs whose population counts differ beyond the radius are skipped. Each pair of tiles
    gives a forest of its links, so large groups of near copies give no more rows than they have
    members. No link is lost.

    Returns doc_id, fingerprint (16 hex digits), component_id long (smallest doc_id reachable). Words
    are runs of non-blanks of the whole text, however long, with A-Z lower-cased; shingles count as
    often as they stand; fewer than n words are one shingle. Null, empty or blank texts have
    fingerprint zero and link like any other. Repeated rows and rows that share an id come out once
    each. A row without an id links too; its component is the smallest id it reaches, null if there is
    none. Other columns are ignored; an empty table gives none.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = materialise(texts.mapInArrow(_fingerprints(n), "doc_id long, fp long"))
    groups = materialise(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = materialise(_tile_pairs(groups, radius).groupBy("a", "b").applyInArrow(_compare(radius), "a long, b long"))
    roots = connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    of = materialise(groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return made.join(of.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
