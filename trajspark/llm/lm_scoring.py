"""Language-model scoring: cross-entropy difference of a target and a background model."""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels, materialise
from .toxicity import held_out

#: Words whose single counts go to every task; rarer words all have the mean probability of their kind.
#: Of pairs, only those of the TOP most frequent words go to every task.
VOCABULARY, TOP = 65_536, 1_024
#: Weight of the pair model against single words, and added to the count of every word.
PAIR_WEIGHT, ADDED = 0.6, 0.5
#: Target ids of 8 bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words that a task holds at once, and words that it remembers.
AT_ONCE, REMEMBERED = 200_000, 250_000
#: Pairs of a bucket on the average, pairs that a task holds before it deals them to buckets, and buckets
#: of a shuffle partition at least.
BUCKET, HELD, SPREAD = 500_000, 1_000_000, 4
#: Keys of pairs: bits of a frequent word beside the digest of a rare one, and the first key with a rare
#: second word. A rare first word's pairs have the sign bit.
DIGEST_BITS, SECOND_RARE = 45, 1 << 62


class Vocabulary(NamedTuple):
    """Counts in the background (row 0) and the target (row 1)."""

    places: dict[bytes, int]  # 1 .. of frequent words; 0 is the start of a text
    context: np.ndarray  # how often a word stands before another, by place
    pairs: np.ndarray  # counts of pairs of the first `top` places, row by row
    chance: np.ndarray  # probability of a single word by place; the last is that of any rarer word
    top: int
    words: int  # of all texts


def _words(text: str | None) -> list[bytes]:
    """Lower-cased runs of anything but blanks, tabs and line ends."""
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


class _Places(dict):
    """Place of every word that a task has met: frequent words have theirs, others come after them."""

    def __init__(self, words: dict[bytes, int]):
        super().__init__(words)
        self.frequent, self.digests = len(words) + 1, []

    def __missing__(self, word: bytes) -> int:
        import xxhash

        place = self[word] = self.frequent + len(self.digests)
        self.digests.append(xxhash.xxh3_64_intdigest(word) >> 2)
        return place


def _slices(batch: pa.RecordBatch, column: str = "text"):
    """Start, end and words of each text, for a part of a batch at a time."""
    found, start, size = [], 0, 0
    for i, text in enumerate(batch.column(column).to_pylist(), 1):
        found.append(_words(text))
        size += len(found[-1])
        if size > AT_ONCE or len(found) == 1 << 12 or i == batch.num_rows:
            yield start, i, found
            found, start, size = [], i, 0


def _placed(places: _Places, found: list[list[bytes]]):
    """Text, place of the word before (0: start) and place of each word; number of words of each text."""
    n = np.array([len(f) for f in found], np.int64)
    of = np.repeat(np.arange(len(n)), n)
    at = np.fromiter((p for f in found for p in map(places.__getitem__, f)), np.int64, len(of))
    before = np.r_[0, at[:-1]] if len(at) else at
    before[(np.cumsum(n) - n)[n > 0]] = 0
    return of, before, at, n


#: Counts of a word: everywhere and in the target, and of those the ones at the end of a text.
COUNTS = ("n", "n_target", "last", "last_target")


def _count_words(batches):
    """Counts of words in a task; the empty word counts texts with words."""
    every, target, last, last_target = counters = [Counter() for _ in COUNTS]

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(every), pa.binary()), *(pa.array([c[w] for w in every], pa.int64()) for c in counters)], ["word", *COUNTS])
        for c in counters:
            c.clear()
        return out

    for batch in batches:
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist(), strict=True):
            if found := _words(text):
                last[found[-1]] += 1
                last_target[found[-1]] += bool(wanted)
                found.append(b"")
            every.update(found)
            if wanted:
                target.update(found)
        if len(every) > 200_000:
            yield rows()
    if every:
        yield rows()


def _count_pairs(words: dict[bytes, int], top: int):
    def count(batches):
        places, sums = _Places(words), np.zeros((2, top * top), np.int64)
        for batch in batches:
            wanted = np.array(batch.column("target").to_pylist(), bool)
            for i, j, found in _slices(batch):
                of, before, at, _ = _placed(places, found)
                often = (before < top) & (at < top)
                pair, is_target = (before * top + at)[often], wanted[i:j][of[often]]
                sums[0] += np.bincount(pair[~is_target], minlength=sums.shape[1])
                sums[1] += np.bincount(pair[is_target], minlength=sums.shape[1])
                if len(places.digests) > REMEMBERED:
                    places = _Places(words)
        at = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["pair", "n_background", "n_target"])

    return count


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of columns of whole numbers from 0 on, and how often each stands."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 63:
        found, k = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        return list(found.T), k
    key = columns[0]
    for c, b in zip(columns[1:], bits[1:], strict=True):
        key = key << b | c
    key, k = np.unique(key, return_counts=True)
    out = []
    for b in bits[:0:-1]:
        out.append(key & (1 << b) - 1)
        key = key >> b
    return [key, *out[::-1]], k


def _gain(n, before, chance):
    """By how much a pair that other documents have n times after n `before` lowers a word's loss."""
    return np.log1p(PAIR_WEIGHT / (1 - PAIR_WEIGHT) * n / np.maximum(before, 1) / chance)


def _dealt(buckets: int, first: int, held: list[list[np.ndarray]]):
    """Columns of a row a bucket: bucket, first, and its pairs' arrays as bytes. `held` has parts of the
    groups, keys, rows above `first` and k of pairs. Only a group of a rare first word differs from the key."""
    group, key, row, k = map(np.concatenate, zip(*held, strict=True))
    bucket = ((group.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
    # sorts of 16 bits take a pass a byte
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
    bucket, group, key = bucket[order].astype(np.int64), group[order], key[order]
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[start, len(key)]
    rare = np.r_[0, np.cumsum(key < 0)][ends]
    packed = [(group[key < 0], rare), (key, ends), ((row[order] - first).astype(np.uint32), ends), (k[order].astype(np.uint32), ends)]
    # bytes of a flush are far below the 2 GB that offsets of 32 bits reach
    blobs = [pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x, at in packed]
    return [pa.array(bucket[start]), pa.array(np.full(len(start), first)), *blobs]


#: Columns of pairs that were dealt to buckets.
PACKED = ("groups", "keys", "rows", "ks")


def _texts_and_pairs(v: Vocabulary, id_col: str, buckets: int, most: int = HELD):
    """A row a text (of_text: its row, words and losses x, y by single words and pairs of the top places),
    and the other pairs of many texts as a row a bucket, which their groups choose: group, key, row of the
    text, and k: twice how often the pair stands there, and one more if the text is of the target."""
    frequent = len(v.places) + 1

    def rows(batches):
        places, row = _Places(v.places), TaskContext.get().partitionId() << 40
        held, n_held, first, kind = [], 0, row, None

        def out():
            columns = _dealt(buckets, first, held)
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), kind)], ["bucket", "first", *PACKED, "of_text"])

        for batch in batches:
            wanted = np.array(batch.column("target").to_pylist(), bool)
            for i, j, found in _slices(batch):
                of, before, at, n = _placed(places, found)
                single = np.minimum(at, frequent)
                losses = [np.bincount(of, -np.log((1 - PAIR_WEIGHT) * v.chance[r][single]), len(n)) for r in (0, 1)]
                (of, a, b), k = _distinct(of, before, at)
                own = wanted[i:j][of]
                often = (a < v.top) & (b < v.top)
                o, f, s, t = of[often], a[often], b[often], k[often]
                for r in (0, 1):
                    mine = t * (own[often] == bool(r))
                    losses[r] -= np.bincount(o, t * _gain(v.pairs[r][f * v.top + s] - mine, v.context[r][f] - mine, v.chance[r][s]), len(n))
                of, a, b, k, own = of[~often], a[~often], b[~often], k[~often], own[~often]
                digests = np.array(places.digests, np.int64)
                rare_a, rare_b = a >= frequent, b >= frequent
                da, db = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
                da[rare_a], db[rare_b] = digests[a[rare_a] - frequent], digests[b[rare_b] - frequent]
                low = (1 << DIGEST_BITS) - 1
                key = np.where(rare_b, SECOND_RARE | a << DIGEST_BITS | db & low, a << 20 | b)
                with np.errstate(over="ignore"):
                    # a rare first word's pairs meet in one group, which counts it; the sign bit marks them
                    key = np.where(rare_a, np.where(rare_b, -SECOND_RARE + (da * 31 + db & SECOND_RARE - 1), np.iinfo(np.int64).min + (b << DIGEST_BITS | da & low)), key)
                group = np.where(rare_a, -SECOND_RARE + da, key)
                ids = row + np.arange(len(n))
                own_ids = batch.column(id_col).slice(i, j - i)
                of_text = pa.StructArray.from_arrays([pa.array(ids), pa.array(n), *map(pa.array, losses), own_ids], ["row", "n", "x", "y", id_col])
                kind, none = of_text.type, pa.nulls(len(n), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids % buckets), pa.array(ids), *[none] * len(PACKED), of_text], ["bucket", "first", *PACKED, "of_text"])
                held.append([group, key, ids[of], k * 2 + own])
                row, n_held = row + len(n), n_held + len(key)
                if n_held > most:
                    yield out()
                    n_held, first = 0, row
                if len(places.digests) > REMEMBERED:
                    places = _Places(v.places)
        if n_held:
            yield out()

    return rows


def _losses_of_pairs(context: np.ndarray, chance: np.ndarray, id_col: str):
    """Rows of _texts_and_pairs of a bucket, as row, n, l0, l1, id_col: what a text starts from, and by
    how much each pair that another text has too lowers its losses."""

    def lowered(group, key, row, k):
        """`group` has the groups of keys below 0, those of a rare first word, only."""
        is_rare = key < 0
        rare, rest = np.flatnonzero(is_rare), np.flatnonzero(~is_rare)
        by_group = np.lexsort((key[rare], group))
        group, rest = group[by_group], rest[np.argsort(key[rest], kind="stable")]
        order, n_rare = np.r_[rare[by_group], rest], len(rare)
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        if n_rare:
            begin = np.r_[True, group[1:] != group[:-1]]
            new[:n_rare] |= begin
            whole = [np.bincount(np.cumsum(begin) - 1, k[order[:n_rare]] // 2 * (k[order[:n_rare]] % 2 == r)) for r in (0, 1)]
        # pairs that one row has only change nothing
        shared = np.flatnonzero(~(new & np.r_[new[1:], True]))
        pair, key, row, k = np.cumsum(new[shared]) - 1, key[shared], row[order[shared]], k[order[shared]]
        own, k = k & 1, k >> 1
        mine = [k * (1 - own), k * own]
        rare_a = shared < n_rare
        rare_b = (key >= SECOND_RARE) | (key < 0) & (key >= -SECOND_RARE)
        digits = (key & SECOND_RARE - 1) >> DIGEST_BITS
        a = np.where(rare_b, digits, key >> 20)[~rare_a]
        b = np.where(rare_b, -1, np.where(rare_a, digits, key & (1 << 20) - 1))  # the last is any rare word's
        losses = []
        for r in (0, 1):
            of_group = whole[r][(np.cumsum(begin) - 1)[shared[rare_a]]] if n_rare else np.empty(0)
            before = np.r_[of_group, context[r][a]]
            losses.append(-k * _gain(np.bincount(pair, mine[r])[pair] - mine[r], before - mine[r], chance[r][b]))
        return row, losses

    def rows(bucket: pa.Table) -> pa.Table:
        names, parts = ["row", "n", "l0", "l1", id_col], []
        texts = bucket.filter(bucket.column("of_text").is_valid()).column("of_text").combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        parts.append(pa.Table.from_arrays(texts.flatten(), names))
        dealt = bucket.filter(bucket.column("keys").is_valid())
        if len(dealt):
            blobs = [dealt.column(c).to_pylist() for c in PACKED]
            group, key, row, k = (np.frombuffer(b"".join(x), t) for x, t in zip(blobs, (np.int64, np.int64, np.uint32, np.uint32), strict=True))
            first = np.repeat(dealt.column("first").to_numpy(), [len(x) // 8 for x in blobs[1]])
            row, losses = lowered(group, key, first + row, k.astype(np.int64))
            parts.append(pa.Table.from_arrays([pa.array(row), pa.nulls(len(row), pa.int64()), *map(pa.array, losses), pa.nulls(len(row), texts.type.field(4).type)], names))
        return pa.concat_tables(parts)

    return rows


def learn_vocabulary(marked: DataFrame, vocabulary: int = VOCABULARY, top: int = TOP) -> Vocabulary:
    """Counts of all words, of which the most frequent are kept, and of the pairs of the `top` ones."""
    counted = materialise(marked.mapInArrow(_count_words, "word binary, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    own = counted.where(F.octet_length("word") > 0)
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0)), F.count(F.lit(1))).first()
    first = own.orderBy(F.col("n").desc(), "word").limit(vocabulary).toArrow()
    starts = counted.where(F.octet_length("word") == 0).select(*COUNTS).first() or (0, 0, 0, 0)
    places = {w: i for i, w in enumerate(first.column("word").to_pylist(), 1)}
    n, n_target, last, last_target = (np.r_[s, first.column(c).to_numpy()] for s, c in zip(starts, COUNTS, strict=True))
    single = np.array([n - n_target, n_target])
    context = single - [last - last_target, last_target]
    whole = np.array([total[0] - total[1], total[1]])
    rare = total[2] - len(places)
    mean = (whole - single[:, 1:].sum(axis=1)) / max(rare, 1)
    chance = (np.c_[single, mean] + ADDED) / np.maximum(whole + ADDED * total[2], ADDED)[:, None]
    top = min(top, len(places) + 1)
    sums = marked.mapInArrow(_count_pairs(places, top), "pair long, n_background long, n_target long").groupBy("pair").agg(F.sum("n_background").alias("n_background"), F.sum("n_target").alias("n_target")).toArrow()
    pairs = np.zeros((2, top * top), np.int64)
    for r, c in enumerate(("n_background", "n_target")):
        pairs[r, sums.column("pair").to_numpy()] = sums.column(c).to_numpy()
    return Vocabulary(places, context, pairs, chance, top, total[0])


def score_corpus(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, top: int = TOP) -> DataFrame:
    """id_col, n_words long, ce_target, ce_background (mean loss a word), score = their difference.

    Two n-gram models of one vocabulary and form: the target's of the documents whose id is in
    `target`, the background's of all others. A word's probability is that of the pair with the word
    before it, mixed with that of the word alone; a document's own pairs are left out of the counts
    that score it. The lower the score, the more a text is like the target.

    Pair counts are exact and grow with the documents: every text's distinct pairs meet by pair, once,
    and only those that another text has too go back to their texts. A pair's probability is its share
    of the pairs that its first word begins, whatever the word's frequency. Pairs of the `top` words,
    which are the hottest, are counted apart; a group is one other pair, or all pairs of one rare first
    word. Groups are dealt to buckets, whose number grows with the words, and travel as a row for each
    bucket of many texts' pairs; a task holds a bucket, in which a group has as many pairs as texts have
    such a pair. Single
    counts are exact for the `vocabulary` most frequent words; rarer ones share their mean.

    Null, empty or blank text: 0 words, the rest null; texts may be of any length. Repeated rows are
    scored each, and count as other documents to each other. Null ids are never of the target; rows
    without target count only for the background. Other columns are ignored. An empty table gives none.
    """
    kind = docs.select(F.col(id_col).alias("_id")).schema["_id"].dataType.simpleString()
    ids = materialise(target.select(F.col(id_col).alias("_id"), F.lit(True).alias("target")).where("_id is not null").distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(ids, "_id", "left").select("_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    v = learn_vocabulary(marked.select("text", "target"), vocabulary, top)
    spark = docs.sparkSession
    buckets = max(math.ceil(v.words / BUCKET), SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = "bucket long, first long, " + "".join(f"{c} binary, " for c in PACKED)
    rows = marked.mapInArrow(_texts_and_pairs(v, "_id", buckets), f"{packed}of_text struct<row: long, n: long, x: double, y: double, _id: {kind}>")
    lowered = rows.groupBy("bucket").applyInArrow(_losses_of_pairs(v.context, v.chance, "_id"), f"row long, n long, l0 double, l1 double, _id {kind}")
    sums = lowered.groupBy("row").agg(F.first("_id", ignorenulls=True).alias(id_col), F.max("n").alias("n_words"), F.sum("l0").alias("l0"), F.sum("l1").alias("l1"))
    ce = [F.when(F.col("n_words") > 0, F.col(f"l{r}") / F.col("n_words")) for r in (0, 1)]
    return sums.select(id_col, "n_words", ce[1].alias("ce_target"), ce[0].alias("ce_background"), (ce[1] - ce[0]).alias("score"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic, without every fifth (held out)."""
    target = labels(spark, sf_dir).where((F.col("quality") == 1) & (F.col("toxic") == 0) & ~held_out())
    return score_corpus(documents(spark, sf_dir).select("doc_id", "text"), target)
