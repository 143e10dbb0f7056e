"""Merkle manifest of a dataset: a tree a source, and one over the sources, by sibling-shift self-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise

FAN = 3
LEAF_COLS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*cols: Column) -> Column:
    return F.sha2(F.concat(*map(field, cols)), 256)


def numbered(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """df with idx (from 0, by order in each tree) and n (rows of the tree).

    Rows are dealt to ranges of (tree, order) and written; a row's number is its place in its range and
    tree, plus the rows of the tree in earlier ranges. No task holds a whole tree. Rows that are equal
    in order stand in any one order.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())  # rows that are equal may lie in several ranges
    dealt = dealt.repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    at = F.monotonically_increasing_id()  # a range's number, and 33 bits of the place in it
    dealt = materialise(dealt.withColumns({"_part": F.shiftrightunsigned(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = dealt.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    of_tree = Window.partitionBy(tree)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_rows").over(of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_rows").over(of_tree)})
    counts = counts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_p"), "_first", "_before", "n")
    same = dealt[tree].eqNullSafe(counts["_tree"]) & (dealt["_part"] == counts["_p"])
    return dealt.join(counts, same).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_tree", "_p", "_first", "_before")


def _siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """nodes with the digests of their siblings before and after them: one equijoin with computed
    sibling indices for each slot offset (exclusive or with 1, if two siblings are a run)."""
    slot = F.col("idx") % fan
    core = nodes.select("tree", F.col("idx").alias("sibling"), "digest")
    for o in range(1, fan):
        index = F.col("idx").bitwiseXOR(F.lit(1)) if fan == 2 else F.col("idx") - slot + (slot + o) % fan
        nodes = nodes.withColumn("sibling", index).join(core.withColumnRenamed("digest", f"_{o}"), ["tree", "sibling"], "left").drop("sibling")
    by_offset = [F.coalesce(f"_{o}", F.lit("")) for o in range(1, fan)]
    pick = lambda s: F.get(F.array(*by_offset), F.pmod(F.lit(s) - slot, F.lit(fan)).cast("int") - 1)
    before = [F.when(slot > s, pick(s)).otherwise("") for s in range(fan)]
    after = [F.when(slot < s, pick(s)).otherwise("") for s in range(fan)]
    return nodes.withColumns({"before": F.concat(*before), "after": F.concat(*after)}).drop(*(f"_{o}" for o in range(1, fan)))


def folded(leaves: DataFrame, fan: int) -> list[DataFrame]:
    """The levels of all trees, from the leaves (tree, idx, n, digest, and more), each written with the
    siblings before and after every node. Rows with n = 1 are roots; the last level has no others."""
    levels, now = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(materialise(_siblings(now.where("n > 1"), fan).unionByName(now.where("n = 1").withColumns({"before": F.lit(""), "after": F.lit("")}))))
        parents = levels[-1].where((F.col("n") > 1) & (F.col("idx") % fan == 0))
        now = parents.select("tree", F.expr(f"idx div {fan}").alias("idx"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.sha2(F.concat("before", "digest", "after"), 256).alias("digest"))
        most = -(-most // fan)
    return [*levels, materialise(now.withColumns({"before": F.lit(""), "after": F.lit("")}))]


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree, digest of every tree's root."""
    return reduce(DataFrame.union, [x.where("n = 1").select("tree", "digest") for x in levels])


def proofs(levels: list[DataFrame], above: DataFrame, fan: int) -> DataFrame:
    """The leaves with path: the siblings before and after, level by level, on the way from the leaf to
    the root, then those of `above` (tree, path and what else belongs to a tree), which the root gets.

    From the top down, every node's path is its own siblings and its parent's path: one join a level,
    of as many rows as the level has. All levels but the leaves are written, so that no plan has more
    joins than two, whatever the tree's height: one plan of all levels took the driver's memory.
    """
    found, more = None, [c for c in above.columns if c not in ("tree", "path")]
    for level in reversed(levels):
        at_root = level.where("n = 1").join(above, "tree")
        if found is not None:
            up = materialise(found).select("tree", F.col("idx").alias("_up"), F.col("path").alias("_path"), *more)
            path = F.concat(F.array(F.struct("before", "after")), "_path").cast(PATH)
            below = level.where("n > 1").withColumn("_up", F.expr(f"idx div {fan}")).join(up, ["tree", "_up"]).withColumn("path", path).drop("_up", "_path")
            at_root = at_root.unionByName(below)
        found = at_root
    return found


def refolded(digest: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "source", leaf_cols: tuple[str, ...] = LEAF_COLS, changed: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """Leaves, subroots, root and inclusion proofs of a table's rows.

    A leaf is the SHA-256 of a row's leaf_cols, each with its length; a tree a value of tree_col has
    its leaves ordered by id_col; every `fan` consecutive nodes (the last run: fewer, even one) become
    the digest of their concatenation, until one is left, the subroot; subroots ordered by tree_col
    (null first, by bytes) give the root in the same way. A lone node is a root itself.

    Returns doc_id, leaf, subroot, root, path (siblings before and after, level by level), changed
    leaf (the leaf with the columns `changed` in place of its own; the leaf, without any). Nulls are
    marked apart from empty texts, so every column may be null; a null tree is one of its own. Rows of
    one id stand in order of their leaves, null ids first; repeated rows are leaves each. Texts may
    be of any length: only their digests leave the scan. Other columns are ignored. An empty table
    gives none. Only one number a tree of the height comes to the driver.
    """
    changed = changed or {}
    columns = [F.col(c) for c in leaf_cols]
    instead = leaf(*(changed.get(c, F.col(c)) for c in leaf_cols)) if changed else leaf(*columns)
    leaves = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(tree_col).cast("string").alias("name"), leaf(*columns).alias("digest"), instead.alias("changed")))
    placed = materialise(numbered(leaves, "name", ["doc_id", "digest"]))
    # sources as trees of the tree above them: one row a source
    sources = materialise(numbered(placed.where("idx = 0").select("name", F.lit(0).alias("top")), "top", ["name"]).select("name", F.col("idx").alias("tree"), F.col("n").alias("trees")))
    named = sources.withColumnRenamed("name", "_name")
    levels = folded(placed.join(named, F.col("name").eqNullSafe(F.col("_name"))).select("doc_id", "changed", "tree", "idx", "n", "digest"), fan)
    subroots = roots(levels).join(sources.select("tree", "trees"), "tree")
    top = folded(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"), "digest"), fan)
    root = roots(top).select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    above = materialise(proofs(top, root, fan).select(F.col("idx").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))
    return proofs(levels, above, fan).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "changed")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle_manifest(documents(spark, sf_dir), changed={"text": tampered})
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    found = made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), refolded(F.col("changed"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
    -- the last bit of the CRC-32 of the id, byte by byte and bit by bit
    list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ord(c)::BIGINT),
      lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) & 1 = 1 AND doc_id IS NOT NULL AS even
  FROM documents),
d AS (SELECT doc_id, source, head, text, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS other FROM f),
h AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS changed FROM d),
i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM h),
-- all levels of each source's tree, as lists
t AS (SELECT source, 0 AS level, 1::BIGINT AS width, list(leaf ORDER BY idx) AS nodes FROM i GROUP BY source
  UNION ALL SELECT source, level + 1, 3 * width, list_transform(range(0, (len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[3 * k + 1 : 3 * k + 3], ''))) FROM t WHERE len(nodes) > 1),
s AS (SELECT source, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS no FROM t WHERE len(nodes) = 1),
u AS (SELECT 0 AS level, 1::BIGINT AS width, list(subroot ORDER BY no) AS nodes FROM s
  UNION ALL SELECT level + 1, 3 * width, list_transform(range(0, (len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[3 * k + 1 : 3 * k + 3], ''))) FROM u WHERE len(nodes) > 1),
r AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1),
-- of each document and level, the siblings before and after it
p AS (SELECT i.source, doc_id, idx, level, array_to_string(nodes[3 * (idx // width // 3) + 1 : idx // width], '') AS before,
    array_to_string(nodes[idx // width + 2 : 3 * (idx // width // 3) + 3], '') AS after
  FROM i JOIN t ON i.source IS NOT DISTINCT FROM t.source WHERE len(nodes) > 1
  UNION ALL SELECT i.source, doc_id, idx, height + u.level, array_to_string(nodes[3 * (no // width // 3) + 1 : no // width], ''),
    array_to_string(nodes[no // width + 2 : 3 * (no // width // 3) + 3], '')
  FROM i JOIN s ON i.source IS NOT DISTINCT FROM s.source, u WHERE len(nodes) > 1),
g AS (SELECT source, idx, list(struct_pack(b := before, a := after) ORDER BY level) AS path FROM p GROUP BY source, idx),
e AS (SELECT i.*, coalesce(path, []) AS path FROM i LEFT JOIN g ON i.source IS NOT DISTINCT FROM g.source AND i.idx = g.idx),
w AS (SELECT source, idx, 0 AS k, changed AS digest, path FROM e
  UNION ALL SELECT source, idx, k + 1, sha256(path[k + 1].b || digest || path[k + 1].a), path FROM w WHERE k < len(path))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(e.path, lambda x: x.b || x.a), '')) AS proof_sha256,
  digest AS folded_root, digest = root AS verified
FROM e JOIN s ON e.source IS NOT DISTINCT FROM s.source, r, w WHERE w.source IS NOT DISTINCT FROM e.source AND w.idx = e.idx AND k = len(e.path)
"""
