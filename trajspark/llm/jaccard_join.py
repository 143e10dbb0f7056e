"""Exact n-gram Jaccard join of documents by PartEnum signatures."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise

#: First-level parts by differences allowed, and second-level parts of each, of which signatures leave out one.
FIRST, PARTS = 0.75, 2
#: Rounds of pivots before all pairs that are still open are compared.
PIVOT_ROUNDS = 2
#: Least and most bits of a parity sketch, of which each element of a set flips one.
SKETCH = 256, 4096
#: Nodes of one signature that meet in one group; larger signatures are dealt to pairs of such blocks.
BLOCK = 256
#: Rows without an id are told apart by a digest of their text from here on.
NO_ID = 1 << 62
#: Ids broadcast at most (8 bytes each); more are joined by shuffles.
BROADCAST_IDS = 500_000


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Well-spread 64-bit hash of 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class _Words(dict):
    """64-bit hash of a word, the same in every worker."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Words().__getitem__


def shingles(text: str | None, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's n-word shingles, sorted; fewer words are one shingle.

    The words of bytes are those between blanks, tabs and line ends, and only A-Z change case.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes, found), np.uint64, len(found))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out, 0))


@lru_cache(maxsize=16)
def bands(percent: int, upto: int) -> tuple[tuple[int, int], ...]:
    """Bands (least, most) of set sizes: sets that link are in one band or in neighbours."""
    out, low = [], 1
    while low <= upto:
        high = max(low, low * 100 // percent)
        out.append((low, high))
        low = high + 1
    return tuple(out)


def _band(size: int, percent: int) -> int:
    upto = 1024
    while upto < size:
        upto *= 2
    ends = [b[1] for b in bands(percent, upto)]
    return int(np.searchsorted(ends, size))


def signatures(items: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """PartEnum signatures of a set (hashes, distinct), and how many more of them may be dropped, for
    each instance that it takes part in.

    Instance j joins sets of band j with each other and with those of band j + 1; each set takes part
    in the instances of its own band and of the one below. Linked sets of an instance differ in at
    most k elements. The domain is dealt to n1 parts and each of these to n2 second-level parts; a
    signature stands for a part without one of its second-level parts. A part with one difference
    leaves one signature equal, a part without any all n2, so linked sets agree on `agreed` signatures
    or more. In any order of signatures that is the same for all sets, each set can therefore do
    without the first agreed - 1: the last one that both have is kept by both. The order is: those
    that stand for no element, which are dropped here, then the most frequent ones. An instance whose
    sets must be equal to link has none.
    """
    size, own = len(items), _band(len(items), percent)
    upto = 1024
    while upto < 2 * size + 64:
        upto *= 2
    all_bands = bands(percent, upto)
    out = []
    for j in (own, own - 1):
        if j < 0:
            continue
        k = (100 - percent) * (all_bands[j][1] + all_bands[j + 1][1]) // (100 + percent)
        if k == 0:
            continue
        n1, n2 = max((k + 2) // 2, math.ceil(FIRST * (k + 1))), PARTS
        agreed = 2 * n1 - k if n1 <= k else n2 * (n1 - k) + k
        cell = ((items >> np.uint64(20)) % np.uint64(n1 * n2)).astype(np.int64)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, cell, items)
        counts = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        with np.errstate(over="ignore"):
            both = _mix(sums, 303).reshape(n1, n2) + counts.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            # position matters in a sum of second-level parts
            placed = _mix(both + np.arange(n2, dtype=np.uint64), 404)
            sig = (placed.sum(axis=1, dtype=np.uint64)[:, None] - placed).ravel()
            sig = _mix(sig + np.arange(len(sig), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), j + 505)
        sig = sig & ~np.uint64(1) | np.uint64(j & 1)  # the last bit tells a set's two instances apart
        empty = (counts.sum(axis=1)[:, None] == counts).ravel()
        first = np.flatnonzero(empty)[np.argsort(sig[empty])][: agreed - 1]
        out.append((np.delete(sig, first), agreed - 1 - len(first)))
    return out


def sketch(items: np.ndarray) -> np.ndarray:
    """Parity sketch with a power of two of bits, about as many as elements, as 64-bit integers."""
    bits = min(max(SKETCH[0], 1 << max(len(items) - 1, 0).bit_length()), SKETCH[1])
    flips = np.bincount((items % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _sets(n: int):
    """Size, two sums of hashes, which tell sets apart, and the parity sketch."""

    def emit(batches):
        for batch in batches:
            rows, sketches = [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, n)
                rows.append((len(s), *(int(x.sum(dtype=np.uint64).view(np.int64)) for x in (s, _mix(s, 2)))))
                sketches.append(sketch(s))
            columns = zip(*rows, strict=True) if rows else [()] * 3
            flat = pa.array(np.concatenate(sketches) if sketches else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in sketches])], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), lists], ["doc_id", "n_shingles", "x", "y", "sketch"])

    return emit


def _may_link(percent: int, a: str = "a", b: str = "b") -> Column:
    """Whether sizes n_ and sketches s_ of two nodes allow a link: sets that differ in h elements have
    sketches that differ in at most h bits. A sketch folds to one of half its bits."""
    one, two, n_one, n_two = F.col(f"s_{a}"), F.col(f"s_{b}"), F.col(f"n_{a}"), F.col(f"n_{b}")
    half = lambda s: F.zip_with(F.slice(s, F.lit(1), (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2).cast("int") + 1, F.size(s)), lambda p, q: p.bitwiseXOR(q))
    x = F.when(F.size(one) > F.size(two), half(one)).otherwise(one)
    y = F.when(F.size(two) > F.size(one), half(two)).otherwise(two)
    bits = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return (100 * F.least(n_one, n_two) >= percent * F.greatest(n_one, n_two)) & ((100 + percent) * bits <= (100 - percent) * (n_one + n_two))


def _described(df: DataFrame, nodes: DataFrame, key: str, name: str) -> DataFrame:
    """df with size n_ and sketch s_ of the node in column key."""
    return df.join(nodes.select(F.col("node").alias(key), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}")), key)


def _signed(n: int, percent: int, rows: int = 1_000_000):
    def emit(batches):
        def flat(held):
            ids, sigs, spare = zip(*held, strict=True)
            count = [len(x) for x in sigs]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), count)), pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(spare, np.int32), count))], ["node", "sig", "spare"])

        held, m = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for sig, spare in signatures(shingles(text, n), percent):
                    held.append((doc_id, sig, spare))
                    m += len(sig)
                if m >= rows:
                    yield flat(held)
                    held, m = [], 0
        if held:
            yield flat(held)

    return emit


def _items(n: int):
    def emit(batches):
        for batch in batches:
            sets = [shingles(x, n).view(np.int64) for x in batch.column("text").to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in sets])], pa.int32()), pa.array(np.concatenate(sets) if sets else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "items"])

    return emit


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes in edges (a, b), by alternating large and
    small stars; every round is written to the shared folder. Ends when the stars are still."""
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, before = materialise(now), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # large star: larger neighbours go to the least one
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the others, and the node itself, go to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = materialise(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return materialise(roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (already written)."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def jaccard_links(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose shingle sets link: their whole sets are compared."""
    ids = materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    sets = _among(docs, ids, "doc_id").mapInArrow(_items(n), "doc_id long, items array<long>")
    sets = materialise(sets)
    x, y = (sets.select(F.col("doc_id").alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
    both = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - F.col("both")
    return pairs.join(x, "a").join(y, "b").withColumn("both", both).where(100 * F.col("both") >= percent * union).select("a", "b")


def _kept_signatures(signed: DataFrame) -> DataFrame:
    """sig, node of the signatures that nodes share once each node has dropped the most frequent ones
    that it can do without, in both of its instances."""
    by_sig = Window.partitionBy("sig")
    shared = materialise(signed.withColumn("c", F.count(F.lit(1)).over(by_sig)).where("c > 1"))
    order = Window.partitionBy("node", F.col("sig").bitwiseAND(F.lit(1))).orderBy(F.col("c").desc(), "sig")
    kept = shared.withColumn("place", F.row_number().over(order)).where("place > spare").select("sig", "node")
    return materialise(kept.withColumn("c", F.count(F.lit(1)).over(by_sig)).where("c > 1").select("sig", "node"))


def _star_pairs(named: DataFrame, nodes: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each signature's pivot with the nodes of other components: no more than there are rows."""
    if turn == 0:
        # the node that shares most signatures is likely the middle of its group; later rounds turn to others
        named = named.join(named.groupBy("node").agg((-F.count(F.lit(1))).alias("r")), "node")
    else:
        named = named.withColumn("r", F.xxhash64("node", F.lit(turn)))
    starred = named.withColumn("p", F.min(F.struct("r", "node", "comp")).over(Window.partitionBy("sig"))).where(F.col("p.comp") != F.col("comp"))
    pairs = starred.select(F.least("p.node", "node").alias("a"), F.greatest("p.node", "node").alias("b")).distinct()
    return _described(_described(pairs, nodes, "a", "a"), nodes, "b", "b").where(_may_link(percent)).select("a", "b")


def _open_pairs(named: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs of a signature that lie in different components and whose sketches allow a link. Nodes
    of a large signature are dealt to blocks, and each pair of blocks meets in a group of its own."""
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("sig")) / BLOCK).cast("int")
    dealt = _described(named.withColumn("n", blocks), nodes, "node", "a").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = materialise(dealt.select("sig", "node", "comp", "n_a", "s_a", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))
    # few rows make many comparisons: they are dealt to more tasks than their bytes ask for
    tasks = max(named.sparkSession.sparkContext.defaultParallelism, dealt.count() // BLOCK // 4)
    dealt = dealt.repartition(tasks, "sig", "low", "high")
    one = dealt.where("own = low")
    two = dealt.where("own = high").select("sig", "low", "high", F.col("node").alias("o_node"), F.col("comp").alias("o_comp"), F.col("n_a").alias("n_b"), F.col("s_a").alias("s_b"))
    same_group = (one["sig"] == two["sig"]) & (one["low"] == two["low"]) & (one["high"] == two["high"])
    apart = (one["comp"] != two["o_comp"]) & ((one["low"] < one["high"]) | (one["node"] < two["o_node"]))
    met = one.join(two, same_group & apart & _may_link(percent))
    return met.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents that are linked by 100 * shared >= percent * union of their n-word shingles.

    Documents of equal sets are one node, named by their smallest id; only nodes get signatures. Each
    drops the most frequent signatures that it can do without, so that what many documents share (a
    notice, a common passage) makes no candidates. Nodes that share one of the others are candidates;
    parity sketches rule out those that differ in too many elements to link, and what is left is
    compared on whole sets. Pairs of one component need no comparison: in each round every signature's
    nodes of other components are compared with one pivot, so a group of near copies costs its size,
    not its square; after PIVOT_ROUNDS all candidates that still lie in different components are
    compared. No link between different components is lost.

    Returns doc_id, n_shingles long, component_id long; other columns are ignored. Words are whole
    runs of non-blanks with A-Z lower-cased, of whole texts however long; fewer than n words are one
    shingle; null, empty or blank texts have an empty set and link with nothing. Repeated rows come
    out once each, in one component; rows of one id with different texts are one document of several
    texts. A row without an id links like others: its component is the smallest id that it reaches,
    and null if there is none. Ids are below 2**62. An empty table gives none.
    """
    text = F.col(text_col)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(NO_ID))).alias("doc_id"), text.alias("text"))
    made = materialise(texts.mapInArrow(_sets(n), "doc_id long, n_shingles long, x long, y long, sketch array<long>"))
    full = made.where("n_shingles > 0")
    nodes = materialise(full.groupBy("n_shingles", "x", "y").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")))
    # rows of one id but another text than its node's are harmless: they only add candidates
    kept = _kept_signatures(_among(texts, nodes.select(F.col("node").alias("doc_id")), "doc_id").mapInArrow(_signed(n, percent), "node long, sig long, spare int"))
    links, comps, seen = None, None, None
    for turn in range(PIVOT_ROUNDS + 1):
        if comps is None:
            named = kept.withColumn("comp", F.col("node"))
        else:
            of = kept.join(comps.select("node", F.col("component").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            by_sig = Window.partitionBy("sig")
            # signatures whose nodes are all of one component have nothing left to say
            named = materialise(of.withColumn("l", F.min("comp").over(by_sig)).withColumn("h", F.max("comp").over(by_sig)).where("l <> h").select("sig", "node", "comp"))
            kept = named.select("sig", "node")
        pairs = _star_pairs(named, nodes, turn, percent) if turn < PIVOT_ROUNDS else _open_pairs(named, nodes, percent)
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        if not pairs.count():
            continue
        found = materialise(jaccard_links(texts, pairs, n, percent))
        seen = pairs if seen is None else seen.union(pairs)
        if not found.count():
            continue
        links = found if links is None else links.union(found)
        comps = connected_components(links)
    named = full.select("doc_id", "n_shingles", "x", "y").join(nodes.select("n_shingles", "x", "y", "node"), ["n_shingles", "x", "y"])
    if comps is not None:
        named = named.join(comps, "node", "left").withColumn("node", F.coalesce("component", "node"))
    rest = made.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return named.select("doc_id", "n_shingles", F.col("node").alias("component_id")).union(rest).select(known("doc_id"), "n_shingles", known("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- sets that link share one of their rarest tenth of shingles
f AS (SELECT s, count(*) AS f FROM s GROUP BY s),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS r, n FROM s JOIN f USING (s) JOIN c USING (doc_id)),
p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM r x JOIN r y ON x.s = y.s AND x.doc_id < y.doc_id
  WHERE x.r <= x.n - ceil(0.9 * x.n) + 1 AND y.r <= y.n - ceil(0.9 * y.n) + 1),
i AS (SELECT a, b, count(*) AS k FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.s = x.s GROUP BY a, b),
l AS (SELECT a, b FROM i JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT a AS doc_id, a AS k FROM e UNION SELECT t.doc_id, e.b FROM t JOIN e ON t.k = e.a),
m AS (SELECT doc_id, min(k) AS k FROM t GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(k, doc_id)::BIGINT AS component_id
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
