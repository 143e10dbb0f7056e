"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels

TERM = re.compile(r"[^\W\d_]+")
#: Terms are hashed to 2**HASH_BITS places.
HASH_BITS = 20
#: Letters of a stem, by which inflected and compound words share a term.
STEM = 4
#: Labelled rows to learn from at most (about): more are thinned by a digest of the id.
TRAIN_ROWS = 20_000
#: Terms that the model holds at most: the most associated ones, then the most frequent.
ASSOCIATED, FREQUENT, LEAST_ROWS = 4_096, 1_024, 4
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 25, 256, 0.2, 3e-5, 11


class Model(NamedTuple):
    places: np.ndarray  # sorted hashed terms
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # a row a term


class _Places(dict):
    """Place of a term in a model, -1 if it has none; remembers terms."""

    def __init__(self, places: np.ndarray):
        super().__init__()
        self.of = {int(p): i for i, p in enumerate(places)}

    def __missing__(self, term: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        i = self[term] = self.of.get(hashed(term), -1)
        return i


def hashed(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) >> (32 - HASH_BITS)


def terms(text: str | None) -> set[str]:
    """Distinct lower-cased runs of letters of the whole text, and the stems of long ones."""
    found = set(TERM.findall(text.lower())) if text else set()
    return found | {w[:STEM] + "-" for w in found if len(w) > STEM}


def _train_terms(batches):
    for batch in batches:
        rows = [sorted({hashed(w) for w in terms(x)}) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "terms"])


def _select(flat: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashed terms with the largest chi-square against the label, and the most frequent ones."""
    n, pos = len(y), y.sum()
    size = 1 << HASH_BITS
    both = np.bincount(flat, minlength=size).astype(float)
    hit = np.bincount(flat, weights=y[row], minlength=size)
    expected = both * pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num((hit - expected) ** 2 / (expected * (1 - pos / n) * (1 - both / n)))
    chi[both < LEAST_ROWS] = 0
    best = np.argsort(-chi, kind="stable")[:ASSOCIATED]
    best = best[chi[best] > 10.8]
    often = np.argsort(-both, kind="stable")[:FREQUENT]
    return np.unique(np.r_[best, often[both[often] >= max(LEAST_ROWS, n / 100)]])


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive slices of x that stop at ends."""
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    return total[ends] - total[np.r_[0, ends[:-1]]]


def _margin(model: Model, at: np.ndarray, ends: np.ndarray):
    v = model.factors[at]
    s = _sums(v, ends)
    return model.bias + _sums(model.linear[at], ends) + 0.5 * (s**2 - _sums(v**2, ends)).sum(axis=1), s


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Logistic loss, AdaGrad on shuffled batches. One class only, or no rows: the bias alone."""
    n, pos = len(y), float(y.sum())
    bias = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    empty = Model(np.empty(0, np.int64), bias, np.empty(0), np.empty((0, FACTORS)))
    if not 0 < pos < n:
        return empty
    flat, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(n), [len(r) for r in rows])
    places = _select(flat, row, y)
    if not len(places):
        return empty
    at = np.searchsorted(places, flat).clip(max=len(places) - 1)
    known = places[at] == flat
    at, row = at[known], row[known]
    start = np.searchsorted(row, np.arange(n + 1))
    rng, m = np.random.default_rng(SEED), len(places)
    linear, factors = np.zeros(m), rng.normal(0, 0.01, (m, FACTORS))
    gb, gl, gf = 1e-8, np.full(m, 1e-8), np.full((m, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            part = order[i : i + BATCH]
            idx = np.concatenate([at[start[r] : start[r + 1]] for r in part])
            count = start[part + 1] - start[part]
            z, s = _margin(Model(places, bias, linear, factors), idx, np.cumsum(count))
            g = (1 / (1 + np.exp(-z.clip(-30, 30))) - y[part]) / len(part)
            each = np.repeat(g, count)
            of_linear = np.bincount(idx, weights=each, minlength=m) + DECAY * linear
            way = each[:, None] * (np.repeat(s, count, axis=0) - factors[idx])
            of_factors = np.stack([np.bincount(idx, weights=way[:, f], minlength=m) for f in range(FACTORS)], axis=1) + DECAY * factors
            gb, gl, gf = gb + g.sum() ** 2, gl + of_linear**2, gf + of_factors**2
            bias -= RATE * g.sum() / gb**0.5
            linear -= RATE * of_linear / np.sqrt(gl)
            factors -= 0.5 * RATE * of_factors / np.sqrt(gf)
    return Model(places, float(bias), linear, factors)


def train_toxicity(docs: DataFrame, marks: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labelled rows of docs for which `train` (over id_col) holds.

    At most about TRAIN_ROWS of them, thinned evenly by a digest of the id, so the model, its
    fitting and what reaches the driver (hashed terms of these rows) are bounded at every size.
    Rows without text or label are left out; null ids have no label; repeated labels count once, and
    rows of one id are each learned from. Texts may be of any length; other columns are ignored. One
    class only, or an empty table, gives a model without terms.
    """
    kept = marks.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).dropDuplicates([id_col, label_col])
    kept = (kept if train is None else kept.where(train)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("toxic"))
    share = TRAIN_ROWS / max(1, kept.count())
    # about TRAIN_ROWS ids of 16 bytes: small enough to send to every executor
    thin = F.broadcast(kept.where(F.conv(F.substring(F.md5(F.col("_id").cast("string")), 1, 8), 16, 10).cast("double") < share * 2**32))
    got = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null").join(thin, "_id").select("toxic", "text").mapInArrow(_train_terms, "toxic double, terms array<int>").toArrow()
    rows = [np.array(r, np.int64) for r in got.column("terms").to_pylist()]
    return fit(rows, np.array(got.column("toxic").to_pylist(), float))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col (0 to 1), which takes the place of a column of that name.

    Every whole text, however long, is read once, without a shuffle; the model has at most
    ASSOCIATED + FREQUENT terms. Null or empty text: the score of no terms. Repeated rows and null ids
    are scored like others, equal texts (also texts of equal terms) alike; other columns pass through.
    An empty table gives none.
    """
    kept = [c for c in docs.columns if c.lower() != score_col.lower()]
    schema = docs.select(*(F.col(f"`{c}`") for c in kept), F.lit(0.0).alias(score_col)).schema

    def score(batches):
        places = _Places(model.places)
        for batch in batches:
            at, count = [], []
            for text in batch.column(text_col).to_pylist():
                found = [i for i in map(places.__getitem__, terms(text)) if i >= 0]
                found.sort()
                at += found
                count.append(len(found))
            z, _ = _margin(model, np.array(at, np.int64), np.cumsum(count))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(1 / (1 + np.exp(-z.clip(-500, 500))))], [*kept, score_col])

    return docs.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are kept from learning: CRC-32 of the id's text divisible by 5 (a null id: of no text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train_toxicity(docs, labels(spark, sf_dir), ~held_out())
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
