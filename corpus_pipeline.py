"""A cleaning pipeline over documents: each stage is one operator of the text subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm.common import documents, fresh, labels, materialise
from trajspark.llm.jaccard_join import jaccard_components
from trajspark.llm.mixing import mix_sources, row_key
from trajspark.llm.packing import pack_documents
from trajspark.llm.quality import quality_rules
from trajspark.llm.toxicity import held_out, score_toxicity, train_toxicity

#: Near copies: shingles of five words that are shared to 80% or more.
SHINGLE, PERCENT = 5, 80
#: Rows of ids or digests that a stage broadcasts at most (some 50 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def _small(ids: DataFrame) -> DataFrame:
    ids = materialise(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _row(docs: DataFrame) -> Column:
    """All columns of docs as one, so that none can clash with what a stage adds."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null, empty or short texts go; texts of any length are judged as a
    whole, repeated rows alike. Other columns pass through, whatever their names. An empty table stays
    empty."""
    return quality_rules(docs.select(_row(docs), "text")).where("kept").select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. The model learns from labelled documents that came this far; if
    there are none, no document is known to be toxic and all stay. Null or empty texts have the score
    of no terms; repeated rows are judged alike. Other columns pass through, whatever their names. An
    empty table stays empty."""
    model = train_toxicity(docs, labels(spark, sf_dir), ~held_out())
    if not len(model.places):
        return docs
    score = fresh(docs, "score")
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group. Rows that share one id stay together; rows
    without an id can't be told apart, and stay. Null or empty texts are copies of nothing; texts of any
    length are compared as a whole. Other columns pass through. An empty table stays empty."""
    groups = jaccard_components(docs, SHINGLE, PERCENT)
    first = _small(groups.where("doc_id = component_id").select("doc_id").distinct())
    named = docs.where("doc_id is not null").join(first, "doc_id", "left_semi")
    return named.select(docs.columns).union(docs.where("doc_id is null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times. Documents stay whole: one that is
    taken in part counts from half of its words on. Null, empty or blank texts are never taken. Rows of
    one id and text each get the most copies that one of them gets. A null source is a source. Other
    columns pass through, whatever their names. An empty table stays empty."""
    taken = mix_sources(docs).where("size > 0").withColumn("copies", F.round(F.col("taken") / F.col("size")).cast("int"))
    copies = _small(taken.groupBy("row_key").agg(F.max("copies").alias("copies")).where("copies > 0"))
    mixed = docs.select(row_key().alias("row_key"), _row(docs)).join(copies, "row_key")
    return mixed.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the mixed documents in sequences of 1024 tokens. Null or empty texts are
    one piece, repeated rows are packed each, other columns are ignored; an empty table gives none."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Tokens can't be had in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
