"""Hard-negative mining: anchors in clusters, each of which walks one list of candidates ordered by angular bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score: 30 * positive <= 100 * negative <= 90 * positive.
BAND = (30, 90)
#: A component x counts as floor(SCALE * x).
SCALE = 256
#: Candidates that a group holds, and anchors.
SHARD, ANCHORS = 32_768, 8_192
#: Clusters are fitted to so many anchors at most; anchors a cluster, about, and clusters at most.
FIT_ROWS, MEMBERS, CLUSTERS, ROUNDS = 8_192, 48, 1_024, 8
#: Candidates that are scored at once: at first, and at most.
FIRST_STEP, STEP = 256, 2_048
#: Of a cosine, against rounding.
SLACK = 1e-6


def integers(scale: float):
    """vec_id, label, v: the components as whole numbers, as little-endian doubles. Rows with a null
    vector or a null or non-finite component are left out."""

    def emit(batches):
        for batch in batches:
            kept = []
            for vec_id, label, x in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("vector"), strict=True):
                if x.is_valid and not x.values.null_count:
                    v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                    if np.isfinite(v).all():
                        kept.append((vec_id, label, np.floor(scale * v).astype("<f8").tobytes()))
            ids, labels, vectors = zip(*kept, strict=True) if kept else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "label", "v"])

    return emit


def matrix(vectors: list[bytes], dim: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    dim = max([dim, *(len(v) // 8 for v in vectors)])
    return np.frombuffer(b"".join(v.ljust(8 * dim, b"\0") for v in vectors), "<f8").reshape(len(vectors), dim)


def exact(*parts: np.ndarray) -> list[np.ndarray]:
    """The matrices in the smallest type in which their products are exact."""
    reach = np.prod([float(np.abs(x).max(initial=0)) for x in parts]) * max(x.shape[1] for x in parts)
    if reach < 1 << 24:
        return [x.astype(np.float32) for x in parts]
    if reach < 1 << 53:
        return list(parts)
    return [np.array([[int(c) for c in row] for row in x], object).reshape(x.shape) for x in parts]


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero for zero vectors) and lengths."""
    length = np.sqrt(np.square(x).sum(axis=1))
    return x / np.where(length > 0, length, 1)[:, None], length


def centres(x: np.ndarray, k: int) -> np.ndarray:
    """k unit vectors by spherical k-means, the same for the same rows."""
    u = unit(x)[0]
    at = u[np.linspace(0, len(u) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        near = (u @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, u)
        at = np.where(np.bincount(near, minlength=k)[:, None] > 0, unit(sums)[0], at)
    return at


def first(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k entries of each row: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    start = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - start < k
    return rows[kept], scores[kept], ids[kept]


class Walk:
    """Best entries of some members in a list of candidates whose bounds fall.

    Each row stands for a member and limits (least, most) of a score; it keeps its first k entries. A
    row is certified once no candidate that is left can reach its least score or its k-th entry.
    """

    def __init__(self, member: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, given: tuple = ()):
        self.member, self.low, self.high, self.k, self.given = member, low.copy(), high, k, given
        self.found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        self.live = np.arange(len(member))

    def certify(self, bound: np.ndarray) -> np.ndarray:
        """bound: of each member, for all that is left. The members that still walk."""
        self.live = self.live[bound[self.member[self.live]] >= self.low[self.live]]
        return np.unique(self.member[self.live])

    def take(self, members: np.ndarray, scores: np.ndarray, ids: np.ndarray, not_ids: np.ndarray) -> None:
        """scores: of members (sorted) with candidates ids; a member is no entry of its own (not_ids)."""
        seen = scores[np.searchsorted(members, self.member[self.live])]
        rows, places = np.nonzero((seen >= self.low[self.live, None]) & (seen <= self.high[self.live, None]))
        rows_of = self.live[rows]
        apart = ids[places] != not_ids[self.member[rows_of]]
        rows, places, rows_of = rows[apart], places[apart], rows_of[apart]
        new = (rows_of, seen[rows, places].astype(np.int64), ids[places])
        self.found = first(*(np.concatenate(x) for x in zip(self.found, new, strict=True)), self.k)
        full = np.flatnonzero(np.bincount(self.found[0], minlength=len(self.member)) == self.k)
        last = np.searchsorted(self.found[0], full, "right") - 1
        self.low[full] = np.maximum(self.low[full], self.found[1][last])


def walk_cluster(start: Callable[[np.ndarray, list], Walk], anchors: dict, candidates: dict, same: bool) -> Iterator[tuple[Walk, np.ndarray]]:
    """The list of a cluster is sorted once, and its members of each label walk their part of it: rows
    of the same label, or of others. Yields each label's finished walk with its members."""
    a, c = anchors["x"], candidates["x"]
    a_unit, a_length = unit(anchors["v"])
    centre = unit(a_unit.sum(axis=0)[None])[0][0]
    angle = np.arccos(np.clip(a_unit @ centre, -1, 1)).max(initial=0)
    cosine = np.cos(np.maximum(0, np.arccos(np.clip(candidates["unit"] @ centre, -1, 1)) - angle)) + SLACK
    bound = candidates["length"] * cosine
    order = np.argsort(-bound, kind="stable")
    for label in np.unique(anchors["label"]):
        mine = np.flatnonzero(anchors["label"] == label)
        listed = order[(candidates["label"][order] == label) == same]
        walk, at, step = start(mine, anchors.get("positives")), 0, FIRST_STEP
        while at < len(listed):
            # the greatest of what is left; a negative bound is reached by the shortest vectors, not the first ones
            ahead = max(bound[listed[at]], 0.0)
            going = walk.certify(a_length[mine] * ahead + SLACK)
            if not len(going):
                break
            part = listed[at : at + step]
            walk.take(going, a[mine[going]] @ c[part].T, candidates["id"][part], anchors["id"][mine])
            at, step = at + step, min(2 * step, STEP)
        yield walk, mine


def _sides(table: pa.Table) -> tuple[dict, dict]:
    """Candidates and anchors of a group, in one exact type."""
    sides = []
    flags = np.asarray(table.column("is_anchor"))
    vectors = table.column("v").to_pylist()
    whole = matrix(vectors)
    for is_anchor in (False, True):
        at = np.flatnonzero(flags == is_anchor)
        sides.append({"v": whole[at], "id": np.asarray(table.column("vec_id"))[at], "label": np.asarray(table.column("label"))[at], "at": at})
    for side, x in zip(sides, exact(*(s["v"] for s in sides)), strict=True):
        side["x"] = x
    candidates, anchors = sides
    candidates["unit"], candidates["length"] = unit(candidates["v"])
    return candidates, anchors


def _clusters(table: pa.Table, anchors: dict):
    cluster = np.asarray(table.column("cluster"))[anchors["at"]]
    for c in np.unique(cluster):
        yield {k: v[cluster == c] for k, v in anchors.items()}


def _positives(k: int):
    whole = np.iinfo(np.int64)

    def start(mine: np.ndarray, _) -> Walk:
        return Walk(np.arange(len(mine)), np.full(len(mine), whole.min), np.full(len(mine), whole.max), k)

    def group(table: pa.Table) -> pa.Table:
        candidates, anchors = _sides(table)
        out = []
        for members in _clusters(table, anchors):
            for walk, mine in walk_cluster(start, members, candidates, True):
                row, score, found = walk.found
                out.append((members["id"][mine[row]], found, score))
        return _table(out, ("anchor_id", "positive_id", "positive_score"))

    return group


def _table(parts: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(names, columns, strict=True)})


def _negatives(k: int, band: tuple[int, int]):
    def start(mine: np.ndarray, positives: list) -> Walk:
        asked = [(i, p["positive_id"], p["positive_score"]) for i, m in enumerate(mine) for p in positives[m]]
        member, ids, scores = (np.array(x, np.int64) for x in zip(*asked, strict=True))
        # the least and the most whole score within the band
        low, high = (np.array([f(int(s)) for s in scores], np.int64) for f in (lambda s: -(-band[0] * s // 100), lambda s: band[1] * s // 100))
        return Walk(member, low, high, k, (member, ids, scores))

    def group(table: pa.Table) -> pa.Table:
        candidates, anchors = _sides(table)
        anchors["positives"] = np.empty(len(anchors["id"]), object)
        anchors["positives"][:] = [x for x in table.column("positives").to_pylist() if x is not None]
        out = []
        for members in _clusters(table, anchors):
            for walk, mine in walk_cluster(start, members, candidates, False):
                row, score, found = walk.found
                member, ids, scores = walk.given
                out.append((members["id"][mine[member[row]]], ids[row], found, scores[row], score))
        return _table(out, ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"))

    return group


def _met(candidates: DataFrame, anchors: DataFrame, shards: int, blocks: int) -> DataFrame:
    """One group for each shard of candidates and block of anchors."""
    extra = [c for c in anchors.columns if c not in ("vec_id", "label", "v", "block")]
    a = anchors.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "is_anchor": F.lit(True)})
    c = candidates.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "shard": F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"), "is_anchor": F.lit(False)})
    return a.unionByName(c.withColumns({x: F.lit(None).cast(anchors.schema[x].dataType) for x in extra})).groupBy("shard", "block")


def _in_clusters(anchors: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Anchors with the cluster and the block of each; a block holds whole clusters, or a part of one."""
    k = max(1, min(CLUSTERS, count // MEMBERS))
    sample = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toArrow()
    at = centres(matrix(sample.column("v").to_pylist()), k)

    def nearest(batches):
        for batch in batches:
            if batch.num_rows:
                u = unit(matrix(batch.column("v").to_pylist(), at.shape[1]))[0][:, : at.shape[1]]
                yield batch.append_column("cluster", pa.array((u @ at.T).argmax(axis=1), pa.int64()))

    placed = materialise(anchors.mapInArrow(nearest, "vec_id long, label long, v binary, cluster long"))
    # CLUSTERS rows at most
    sizes = {r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}
    blocks, room, first_block, parts = 0, 0, {}, {}
    for c, n in sorted(sizes.items()):
        parts[c] = -(-n // ANCHORS)
        if parts[c] > 1 or n > room:
            first_block[c], blocks, room = blocks, blocks + parts[c], ANCHORS if parts[c] == 1 else 0
        else:
            first_block[c] = blocks - 1
        room -= n
    table = [(int(c), int(first_block[c]), int(parts[c])) for c in sizes]
    known = anchors.sparkSession.createDataFrame(table, "cluster long, first int, parts int")
    block = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    return placed.join(F.broadcast(known), "cluster").withColumn("block", block).select("vec_id", "label", "v", "cluster", "block"), blocks


def mine_hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each anchor and each of its best rows of the same label (positives), the best rows of other
    labels whose scores lie within a band of the positive's score.

    A score is the inner product of vectors of whole numbers, floor(scale * x). Anchors are clustered
    by direction; candidates are dealt to shards. In a shard, each cluster sorts the candidates once by
    length * cos(angle to the cluster's centre - the cluster's radius), which bounds their scores with
    all members; every member walks that list and leaves it once no later candidate can enter its
    results. Results are exact and do not depend on clusters, shards or blocks; the clusters are fitted
    to FIT_ROWS anchors at most. The best of all shards are merged.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Higher
    scores come first, then smaller ids. `anchor` is a condition on vec_id (long), label and v of the
    prepared rows. Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    Of rows that share an id one counts, that of the smallest label and then the smallest vector (by
    its bytes), so repeated rows count once. Shorter vectors end in zeros. Anchors without a positive,
    and positives without a negative, give no rows; a table without anchors none. Other columns are
    ignored. A score that is no 64-bit integer is an error.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).dropna()
    rows = rows.mapInArrow(integers(scale), "vec_id long, label long, v binary")
    kept = materialise(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v"))
    anchors, total = kept.where(anchor), kept.count()
    count = anchors.count()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count:
        return vectors.sparkSession.createDataFrame([], out)
    shards = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-total // SHARD))
    anchors, blocks = _in_clusters(anchors, count)
    best = _met(kept, anchors, shards, blocks).applyInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    best = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = materialise(anchors.join(best.withColumnRenamed("anchor_id", "vec_id"), "vec_id"))
    found = _met(kept, asked, shards, blocks).applyInArrow(_negatives(negatives, band), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
