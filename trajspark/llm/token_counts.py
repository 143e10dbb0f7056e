"""Token counts with a digest cache."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, scratch_dir
from .encoding import encoder

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the vocabulary file and the version of its library."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


def _encode(path: str):
    def count(batches):
        enc = encoder(path)
        for batch in batches:
            n = pa.array([len(enc.ids(x)) // 4 for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("content"), n], ["content", "n_tokens"])

    return count


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version: content, n_tokens. Appends that ran twice don't count twice."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "content string, n_tokens long")
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, looked up in a cache by digests of content and tokenizer version.

    The cache is a Parquet folder (content, tokenizer, n_tokens), partitioned by tokenizer and only
    ever appended to. Contents that it lacks are encoded once each, however many rows hold them, and
    appended; then every row is joined to the cache. Byte-level vocabularies tell every byte apart,
    so normalisation is null to empty and nothing else.

    Returns id_col, n_bytes long (UTF-8), n_tokens long, over_limit boolean, one row for each input
    row. Null or empty text: 0 bytes, 0 tokens; a text may be of any length. Repeated rows and null ids stay as they are; other
    columns are ignored. An empty table gives an empty result.
    """
    spark, tokenizer = docs.sparkSession, tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.sha2(text, 256)
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content"))
    distinct = docs.select(content.alias("content"), text.alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, tokenizer), "content", "left_anti")
    counted = misses.mapInArrow(_encode(tokenizer_path), "content string, n_tokens long")
    counted.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    # inner: each content is in the cache by now. Counts are written, so that both sides of the join are
    # plain exchanges and Spark can split a content that very many rows hold
    return rows.join(materialise(read_cache(spark, cache, tokenizer)), "content").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), scratch_dir(spark) + "/token-counts")
