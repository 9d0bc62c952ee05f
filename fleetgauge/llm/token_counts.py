"""Token counts by way of a digest cache."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .encoding import piece_table, portions

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens bigint"


def cached_counts(spark: SparkSession, cache: str, tokenizer_version: str) -> DataFrame:
    """Stored counts of one tokenizer version: digest, n_tokens. A cache not yet written is empty."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", "true").parquet(cache) if there \
        else spark.createDataFrame([], CACHE_SCHEMA)
    # two jobs may have added the same digest; their counts are equal
    return rows.where(F.col("tokenizer") == tokenizer_version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, tokenizer_version: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of each of ``docs`` (doc_id, text).

    Content is normalised to what the tokenizer sees (null becomes empty; these byte-level tokenizers change
    nothing else) and digested with SHA-256. Digests without a stored count under ``tokenizer_version``
    are encoded, one text for each digest, and their counts appended to ``cache`` as a batch of
    their own. Copies are folded before the shuffle, so a text held by a third of the rows costs one
    row a task. Repeated doc_ids and null ids keep their rows; an empty table gives no rows.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(tokenizer)
        for batch in batches:
            for part in portions(batch):
                n = table.count(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([tokenizer_version] * part.num_rows, pa.string()), pa.array(n)],
                                                 names=["digest", "tokenizer", "n_tokens"])

    content = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id"), content.alias("text"), F.sha2(content, 256).alias("digest"))
    distinct = texts.groupBy("digest").agg(F.min("text").alias("text"))
    misses = distinct.join(cached_counts(spark, cache, tokenizer_version), "digest", "left_anti")
    misses.mapInArrow(encode, CACHE_SCHEMA).write.parquet(f"{cache}/{uuid.uuid4().hex}")
    known = cached_counts(spark, cache, tokenizer_version)
    rows = texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
