"""Near-duplicates by SimHash: multi-index hashing of fingerprints, then connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .encoding import portions
from .graph import components
from .storage import stored


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """The 64-bit SimHash of the text's word shingles; zero for a text without words.

    A-Z are lower-cased; words are runs of other bytes than ASCII white space. Shingles count
    as often as they occur; a text of fewer words is one shingle.
    """
    import xxhash
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:].tolist()
    begins = [0, *(ends[:n - 1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter([h(joined[a:b], seed) for a, b in zip(begins, last)], np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        bits = np.unpackbits(hashes[at:at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of ``docs`` (doc_id, text). A null text has no words."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                texts = part.column("text").cast(pa.binary()).to_numpy(zero_copy_only=False)
                fps = np.fromiter((fingerprint(t, shingle) if t else 0 for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        hashed, "doc_id bigint, fp bigint")


def _segment(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _neighbours(key: Column, segment: int, width: int) -> Column:
    """The segment's keys with one more bit set."""
    bits = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(width)])
    unset = F.filter(bits, lambda b: key.bitwiseAND(b) == 0)
    return F.transform(unset, lambda b: F.struct(
        F.lit(segment).alias("segment"), key.bitwiseOR(b).alias("key"), F.lit(True).alias("flipped")))


def near_pairs(nodes: DataFrame, max_bits: int) -> DataFrame:
    """a, b: every pair of different fingerprints of ``nodes`` (fp, distinct) at ``max_bits`` or fewer bits.

    Multi-index hashing with m = max_bits // 2 + 1 segments. With max_bits = m * r + a, two close
    fingerprints are within r bits in one of the first a + 1 segments or within r - 1 in another; r is 0 or 1.
    Each fingerprint enumerates that ball around each segment, fetches the tables' matches and compares
    whole fingerprints inside the join. A ball's flips only set bits: of two segments one bit apart, one finds the other.
    """
    m = max_bits // 2 + 1
    radius, first = divmod(max_bits, m)
    bounds = [64 * i // m for i in range(m + 1)]
    entries, probes = [], []
    for i in range(m):
        low, width = bounds[i], bounds[i + 1] - bounds[i]
        r = radius if i <= first else radius - 1
        if r < 0:
            continue
        key = _segment(F.col("fp"), low, width)
        entries.append(F.struct(F.lit(i).alias("segment"), key.alias("key")))
        ball = [F.array(F.struct(F.lit(i).alias("segment"), key.alias("key"), F.lit(False).alias("flipped")))]
        if r == 1:
            ball.append(_neighbours(key, i, width))
        probes.extend(ball)
    table = nodes.select(F.col("fp").alias("b"), F.inline(F.array(*entries)))
    asked = nodes.select(F.col("fp").alias("a"), F.inline(F.concat(*probes)))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    t, p = table.alias("t"), asked.alias("p")
    same = (F.col("p.segment") == F.col("t.segment")) & (F.col("p.key") == F.col("t.key"))
    return p.join(t, same & (F.col("flipped") | (F.col("a") < F.col("b"))) & close).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """doc_id, fp, component_id for each of ``docs`` (doc_id, text).

    component_id is the smallest doc_id among all documents reachable over links of ``max_bits`` or fewer
    differing bits, itself included. Equal fingerprints are folded before any join, so copies are never paired. Texts
    without words share fingerprint zero and link like others. Repeated ids keep a row each; a null id
    has a row, and is a component's id only where no other id is in it. An empty table gives no rows.
    """
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "nodes")
    roots = components(near_pairs(nodes.select("fp"), max_bits))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = linked.groupBy("root").agg(F.min("lowest").alias("component_id"))
    classes = linked.join(names, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """One row of each component, the one with the smallest doc_id (null last) and of those the smallest text; all
    columns of ``docs``, whatever their names. Rows are told apart by numbers of their own: different texts without an id,
    or with the same id, all stay.
    """
    rows = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("__row")), "rows")
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), F.col("doc.text").alias("text")), shingle, max_bits)
    # the smallest row number names a component, so no two share a name
    named = stored(found.select(F.col("doc_id").alias("__row"), "component_id").join(rows.select("__row", F.col("doc.doc_id").alias("doc_id")), "__row"), "named")
    ids = named.groupBy("component_id", "doc_id").agg(F.min("__row").alias("row"), F.count("*").alias("n"))
    first = stored(ids.groupBy("component_id").agg(
        F.min_by(F.struct("doc_id", "row", "n"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("f")).select("component_id", "f.*"), "first")
    # texts are needed only where rows of a component share its smallest id
    ties = first.where("n > 1").select("component_id", F.col("doc_id").alias("__id"))
    tied = named.join(ties, "component_id").where(F.col("doc_id").eqNullSafe(F.col("__id"))).select("__row", "component_id")
    chosen = rows.select("__row", F.col("doc.text").alias("text")).join(tied, "__row").groupBy("component_id").agg(F.min_by("__row", F.struct("text", "__row")).alias("__row"))
    kept = first.where("n = 1").select(F.col("row").alias("__row")).union(chosen.select("__row"))
    return rows.join(kept, "__row", "left_semi").select("doc.*")
