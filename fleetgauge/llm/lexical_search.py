"""Ranked lexical search: the highest-scoring documents of every query text, exactly.

A document's score for an item is an inner product of term weights and saturated term frequencies, all in
integers. Every task builds ball trees over its documents and searches them for all items of a block.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .ball_tree import BallTree, Best
from .encoding import portions
from .storage import stored

_COUNTED = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"
_FOUND = "item_no int, doc_id bigint, score bigint"
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
# fixed values: what separates terms becomes a blank, A-Z becomes a-z, all else stays
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[str]:
    """The terms of one text: runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return [t.decode() for t in _TERM.findall((text or "").encode().translate(_FOLD))]


def _counted(part: pa.RecordBatch, vocabulary: pa.Array) -> pa.RecordBatch:
    """Number of terms of each text, and how often it holds each term of ``vocabulary``."""
    texts = pc.fill_null(part.column("text").cast(pa.string()), "")
    folded = pa.array([t.as_py().encode().translate(_FOLD) for t in texts], pa.binary()).cast(pa.string())
    split = pc.ascii_split_whitespace(folded)
    words = split.flatten()
    row = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    n = np.bincount(row[real], minlength=len(split)).astype(np.int64)
    coded = words.dictionary_encode()
    known = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    number = known[coded.indices.to_numpy()] if len(known) else np.empty(0, np.int64)
    pairs, tfs = np.unique((row * len(vocabulary) + number)[number >= 0], return_counts=True)
    rows, terms = np.divmod(pairs, max(len(vocabulary), 1))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(split)))]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tfs)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])


def count_terms(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per document: doc_id, n (all its terms, with repeats), and the terms of ``vocabulary`` it holds, by number, with tf."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary, pa.string())
        for batch in batches:
            for part in portions(batch):
                yield _counted(part, wanted)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(count, _COUNTED)


def _search(counted: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, total: int,
            top: int, floors: list[int], chunk: int) -> DataFrame:
    """Each task's ``top`` documents of every query, from trees over ``chunk`` documents (or 256 times as many term counts) at a time."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top, floor) for floor in floors]
        scale = np.sqrt(np.maximum(weights, 1).astype(float))

        def look(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts).combine_chunks()
            terms = rows.column("terms").combine_chunks()
            sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = rows.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            # exact: Python integers, since 50 * n * N can pass 64 bits on the largest tables
            m = np.array([50 + 50 * n * documents // total for n in rows.column("n").to_pylist()], np.int64)
            values = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, sizes))
            tree = BallTree(np.concatenate([[0], np.cumsum(sizes)]), flat, values, scale)
            ids = rows.column("doc_id").to_pylist()
            for (query, weight), result in zip(queries, best):
                tree.search(query, weight, scale, ids, result)

        waiting, rows, entries = [], 0, 0
        for batch in batches:
            begin = 0
            for i, size in enumerate(pc.list_value_length(batch.column("terms")).to_pylist()):
                rows, entries = rows + 1, entries + size
                if rows >= chunk or entries >= 256 * chunk:
                    look(waiting + [batch.slice(begin, i + 1 - begin)])
                    waiting, rows, entries, begin = [], 0, 0, i + 1
            if begin < batch.num_rows:
                waiting.append(batch.slice(begin))
        if waiting:
            look(waiting)
        found = [(i, doc_id, score) for i, result in enumerate(best) for doc_id, score in result.rows()]
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))],
                                         names=["item_no", "doc_id", "score"])

    return counted.where(F.size("terms") > 0).mapInArrow(search, _FOUND)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _rank_block(docs: DataFrame, texts: list[str | None], top: int, chunk: int, seed_share: float) -> DataFrame:
    held = [sorted(set(terms_of(t))) for t in texts]
    vocabulary = sorted(set().union(*held))
    counted = stored(count_terms(docs, vocabulary), "search-terms")
    documents, total = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator()) if documents else {}
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    number = {term: i for i, term in enumerate(vocabulary)}
    queries = []
    for terms in held:
        at = np.array([number[t] for t in terms], np.int64)
        at = at[weights[at] > 0]
        queries.append((at, weights[at]))
    # a document of the answer scores at least as much as the last of the best of any part of the documents
    some = _ranked(_search(counted.sample(seed_share, 11), queries, weights, documents, total, top, [1] * len(queries), chunk), top)
    floors = [1] * len(queries)
    for row in some.where(F.col("rank") == top).select("item_no", "score").toLocalIterator():
        floors[row["item_no"]] = row["score"]
    return _ranked(_search(counted, queries, weights, documents, total, top, floors, chunk), top)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 50, block_items: int = 2000, block_chars: int = 4_000_000,
                   chunk: int = 8192, seed_share: float = 1 / 64) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents of each of ``items`` (item_id, text) with a score above 0.

    The score is exact and so is the answer. Terms, weights and statistics cover all of ``docs`` (doc_id, text). Items
    are searched a block at a time (``block_items`` items or ``block_chars`` characters; a longer item is a block of its
    own), so what is sent to all tasks is bounded. Per block the texts are read once and the counts of the block's terms
    stored. The scores of a share ``seed_share`` of the documents first give each item a score that its answer
    reaches at least; then all documents are searched, and tasks return little beyond the answer.

    A null or empty text has no terms: as a document it is in no answer and not counted, as an item it has no rows.
    Equal scores rank by ascending doc_id, a null id last. Repeated rows are ranked each on its own, repeated or
    null item_ids too. Empty tables give no rows. Further columns are not read.
    """
    spark, results, block, chars = docs.sparkSession, [], [], 0
    schema = items.select(F.lit(0).alias("item_no"), "item_id").schema

    def close() -> None:
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], schema)
        ranked = _rank_block(docs, [r["text"] for r in block], top, chunk, seed_share)
        results.append(ranked.join(names, "item_no").select("item_id", "rank", "doc_id", "score"))

    for row in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        size = len(row["text"] or "")
        if block and (len(block) == block_items or chars + size > block_chars):
            close()
            block, chars = [], 0
        block.append(row)
        chars += size
    if not block:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    close()
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
