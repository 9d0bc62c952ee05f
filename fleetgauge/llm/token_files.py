"""Token-id output as ORC: run-length-encoded ids, row indexes, and Bloom filters on the document id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .encoding import piece_table, portions

_STORED = "doc_id bigint, n_tokens bigint, file_start bigint, ids array<int>"
_STORED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("file_start", pa.int64()),
                           ("ids", pa.list_(pa.int32()))])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_mb: int = 16,
                      index_rows: int = 1000) -> None:
    """Encode ``docs`` (doc_id, text) and write ORC files in ascending doc_id order below ``path``.

    Each file holds one range of ids. Rows: doc_id, n_tokens (with ``end_id``), file_start (ids before
    it in its file) and ids. The integer columns are run-length encoded; a row index every ``index_rows`` rows and
    a Bloom filter on doc_id let a reader skip stripes and row groups; stripes are read in parallel.

    A null text is empty (its only id is ``end_id``). Null ids sort first. Repeated ids stay, ordered
    by text. Further columns are not written. An empty table gives files without rows.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, start = piece_table(tokenizer), 0
        for batch in batches:
            for part in portions(batch):
                ids, ends = table.encode(part.column("text"), end_id)
                begins = np.concatenate([[0], ends[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ends - begins), pa.array(begins + start), lists],
                                                 schema=_STORED_ARROW)
                start += len(ids)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    (ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, _STORED)
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.stripe.size", str(stripe_mb << 20)).option("orc.row.index.stride", str(index_rows))
     .option("orc.compress", "ZSTD").orc(path))


def read_token_files(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The stored rows with their file's name; ``doc_ids`` is pushed to the stripes' indexes and filters."""
    rows = spark.read.schema(_STORED).orc(path).select("*", F.col("_metadata.file_name").alias("file"))
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only one row per file meets in one task to find where each file begins.
    """
    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("file", "doc_id", "file_start", "n_tokens")],
                                              pa.array(crc, pa.int64())], names=["file", "doc_id", "file_start", "n_tokens", "ids_crc32"])

    rows = read_token_files(spark, path)
    checked = rows.mapInArrow(checksums, "file string, doc_id bigint, file_start bigint, n_tokens bigint, ids_crc32 bigint")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("lowest"),
                                     F.max(F.col("doc_id").isNull()).alias("nulls"))
    before = W.orderBy(F.col("nulls").desc(), "lowest", "file").rowsBetween(W.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("file_begin"))
    return checked.join(starts, "file").select("doc_id", (F.col("file_begin") + F.col("file_start")).alias("start"),
                                               "n_tokens", "ids_crc32")
