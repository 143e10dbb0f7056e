"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, words

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
#: How often at most the mix goes through a source.
PASSES = 2
BLOCK = 64
#: Words of a shard, and shards at most in all (larger inputs have larger shards).
SHARD_WORDS, SHARDS = 1 << 18, 100_000
SEED = 17
#: Rows of a table of sources that are broadcast; a larger one is joined by shuffles.
BROADCAST_ROWS = 100_000


def _join_sources(df: DataFrame, sources: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    return df.join(F.broadcast(sources) if sources.count() <= BROADCAST_ROWS else sources, on, how)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, passes: int = PASSES) -> DataFrame:
    """source, source_size, no (by code point, null last), weight, target.

    The level that fills `total` of all sizes by weight, when no source goes beyond `passes` times
    its size, is the largest of the levels that result if sources stop in order of size by weight.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop, whole = Window.orderBy("_stop", "no").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = found.withColumn("no", F.row_number().over(ordered))
    found = found.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") - 1) % len(weights) + 1))
    found = found.withColumn("_stop", passes * F.col("source_size") / F.col("weight"))
    level = (total * F.sum("source_size").over(whole) - F.coalesce(F.sum(passes * F.col("source_size")).over(by_stop), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_stop), F.lit(0)))
    found = found.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    return found.withColumn("target", F.least((passes * F.col("source_size")).cast("double"), F.col("_level") * F.col("weight"))).drop("_stop", "_level")


def sainte_lague(parties: DataFrame, votes: str, seats: str, order: str, group: list[str] = []) -> DataFrame:  # noqa: B006
    """parties with quota: `seats` (one number a group) given to the highest quotients votes / (2k - 1).

    Seats that every fitting divisor gives are counted at once; only the few others, at most twice as
    many as parties, are ranked by their quotients. Ties go by `order`.
    """
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sums = parties.withColumns({"_votes": F.sum(votes).over(every), "_parties": F.count(F.lit(1)).over(every)})
    n, v = F.col(seats), F.col(votes)
    sure = F.when((F.col("_votes") > 0) & (2 * n > F.col("_parties")), F.greatest(F.floor(v * (n - F.col("_parties") / 2) / F.col("_votes") + 0.5) - 1, F.lit(0))).otherwise(F.lit(0)).cast("long")
    most = F.when((F.col("_votes") > 0) & (v > 0), F.floor(v * (n + F.col("_parties") / 2) / F.col("_votes") + 0.5) + 1).otherwise(F.lit(0)).cast("long")
    known = sums.withColumns({"_sure": sure, "_most": most}).withColumn("_left", n - F.sum("_sure").over(every))
    tried = known.where("_most > _sure").withColumn("_k", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))))
    rank = F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy((F.col(votes) / (2 * F.col("_k") - 1)).desc(), order, "_k"))
    won = tried.withColumn("_rank", rank).where("_rank <= _left").groupBy(*group, order).agg(F.count(F.lit(1)).alias("_more"))
    return known.join(won, [*group, order], "left").withColumn("quota", F.col("_sure") + F.coalesce("_more", F.lit(0))).drop("_votes", "_parties", "_sure", "_most", "_left", "_more")


def row_key(id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> Column:
    """Seeded digest of a row, by which it is dealt and ordered: of its id and its text, so that rows
    without an id, or with the same one, spread too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, passes: int = PASSES, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How many words of each document a mix of sources takes.

    Each source's documents are dealt by a seeded digest to shards of about `shard_words` words, so a
    hot source is many shards, and stand in a shard in seeded order. Sainte-Laguë gives the mix's
    blocks of `block` words to sources by their targets, and each source's blocks to its shards by
    their sizes. A shard gives its quota from the start of its order, once or up to `passes` times
    round; only where the quota ends is a document taken in part.

    Returns id_col, size, source_size, target (of its source), taken, and source and the row's key;
    sizes in words (long), target double. Null, empty or blank text: size and taken 0. A null source is a source of its
    own, the last. Rows with one id, and repeated rows, are each dealt as documents. Texts may be of any length. The same rows and seed always give
    the same mix. Other columns are ignored. An empty table gives none.
    """
    sized = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), row_key(id_col, text_col, seed).alias("key")))
    targets = source_targets(sized, weights, total, passes)
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long")
    quotas = sainte_lague(targets.withColumn("seats", seats), "target", "seats", "no")
    sources = materialise(quotas.select("source", "source_size", "no", "target", F.col("quota").alias("source_quota"), F.greatest(F.ceil(F.col("source_size") / F.greatest(F.lit(shard_words), F.sum("source_size").over(Window.partitionBy(F.lit(0))) / SHARDS)), F.lit(1)).cast("long").alias("shards")))
    named = sources.withColumnRenamed("source", "_source")
    dealt = _join_sources(sized, named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("shard", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("shards"))
    shards = dealt.groupBy("no", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    given = materialise(sainte_lague(shards, "shard_size", "source_quota", "shard", ["no"]).select("no", "shard", "shard_size", F.least(F.col("quota") * block, passes * F.col("shard_size")).alias("take")))
    before = Window.partitionBy("no", "shard").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    g = given.select(F.col("no").alias("_no"), F.col("shard").alias("_shard"), "shard_size", "take")
    joined = _join_sources(placed, g, (F.col("no") == F.col("_no")) & (F.col("shard") == F.col("_shard")))
    rounds = F.when(F.col("shard_size") > 0, F.expr("take div shard_size")).otherwise(F.lit(0))
    partly = F.greatest(F.lit(0), F.least(F.col("size"), F.col("take") - rounds * F.col("shard_size") - F.col("_before")))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", (rounds * F.col("size") + partly).cast("long").alias("taken"), F.col("source").alias(source_col), F.col("key").alias("row_key"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = f"""
WITH z AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM z GROUP BY source),
w AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
v AS (SELECT *, 2 * source_size / weight AS stop FROM w),
b AS (SELECT *, ({TOTAL}::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER u, 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER u, 0)) AS level FROM v
  WINDOW u AS (ORDER BY stop, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, no, least((2 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM b),
n AS (SELECT round(sum(target) / {BLOCK})::BIGINT AS seats, sum(target) AS votes, count(*) AS parties FROM t),
c AS (SELECT no, target / (2 * k - 1) AS q FROM (SELECT no, target, unnest(range(1, (target * (seats + parties) / votes)::BIGINT + 3)) AS k FROM t, n WHERE target > 0)),
r AS (SELECT no, row_number() OVER (ORDER BY q DESC, no) AS rank FROM c),
q AS (SELECT no, count(*) AS quota FROM r, n WHERE rank <= seats GROUP BY no),
-- at these sizes each source is one shard
d AS (SELECT z.*, t.source_size, t.target, least(coalesce(quota, 0) * {BLOCK}, 2 * source_size) AS take,
    coalesce(sum(size) OVER (PARTITION BY t.no ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source LEFT JOIN q USING (no)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS rounds FROM d)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (rounds * size + greatest(0, least(size, take - rounds * source_size - prior)))::BIGINT AS taken FROM e
"""
