"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .storage import refuse, stored

BLOCK_BITS = 20


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, marked: int, rest: int, drawn: int) -> int:
    """How many of ``drawn`` items taken from ``marked`` + ``rest`` without return are marked.

    Inverts the distribution outward from its mode, so that a draw takes about as many steps as its
    standard deviation.
    """
    low, high = max(0, drawn - rest), min(drawn, marked)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (marked + 1) // (marked + rest + 2)))
    peak = math.exp(_log_choose(marked, mode) + _log_choose(rest, drawn - mode) - _log_choose(marked + rest, drawn))
    u = rng.random() - peak
    up = down = mode
    p_up = p_down = peak
    while u > 0:
        before = u
        if up < high:
            p_up *= (marked - up) * (drawn - up) / ((up + 1) * (rest - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (rest - drawn + down) / ((marked - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if u == before:                          # what is left is below the precision of a double
            return mode
    return mode


def communication_matrix(blocks: Sequence[int], shards: Sequence[int], seed: int) -> list[list[int]]:
    """How many rows of each block go to each shard, as a uniform shuffle of all rows would have it.

    Row sums are ``blocks``, column sums ``shards``; each block draws from the room the ones before left.
    """
    rng, room, out = random.Random(seed), list(shards), []
    for size in blocks:
        left, total, row = size, sum(room), []
        for free in room:
            n = hypergeometric(rng, free, total - free, left)
            row.append(n)
            total -= free
            left -= n
        room = [r - n for r, n in zip(room, row)]
        out.append(row)
    return out


def shuffle_shards(rows: DataFrame, shards: int, seed: int = 0, order: Sequence[str] = ()) -> DataFrame:
    """Add shard (0 to ``shards`` - 1) and slot (gapless from 0 in its shard) by a uniform shuffle.

    Shard sizes differ by one row at most. The rows are written once with their place; a block is at most
    2**20 rows of one partition. The matrix of block-to-shard counts is drawn from the block
    sizes alone, on the driver (``shards`` numbers a block). Each block orders its rows by a keyed
    hash and deals its first rows to shard 0, the next ones to shard 1 and so on. A shard then orders what
    it got by another hash, in buckets of about 2**20 rows whose offsets are summed up, so no task holds a whole
    shard. Equal rows are dealt apart like any others, since the hashes take the stored place in.
    ``order`` is not needed for correctness; columns named there enter the hashes. An empty table gives no rows.
    Columns named shard, slot or like a working column (two underscores first) raise a ValueError.
    """
    refuse(rows, "shard", "slot", "__place", "__block", "__rank", "__upto", "__mix", "__bucket", "__offset", "__slot", "count")
    spark = rows.sparkSession
    placed = stored(rows.withColumn("__place", F.monotonically_increasing_id()), "shard-input")
    placed = placed.withColumn("__block", F.shiftright("__place", BLOCK_BITS))
    counts = placed.groupBy("__block").count().orderBy("__block").collect()
    total = sum(r["count"] for r in counts)
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    matrix = communication_matrix([r["count"] for r in counts], sizes, seed)
    deals = _deals(spark, [r["__block"] for r in counts], matrix)
    key = ["__place", *order]
    local = W.partitionBy("__block").orderBy(F.xxhash64(*key, F.lit(seed)), "__place")
    ranked = placed.withColumn("__rank", F.row_number().over(local))
    dealt = ranked.join(deals, "__block").withColumn("shard", F.size(F.filter("__upto", lambda upto: upto < F.col("__rank"))))
    buckets = max(1, -(-max(sizes) >> BLOCK_BITS))
    mixed = dealt.withColumn("__mix", F.xxhash64(*key, F.lit(seed + 1))).withColumn(
        "__bucket", F.floor(F.shiftrightunsigned("__mix", 40) * F.lit(buckets) / F.lit(1 << 24)).cast("int"))
    mixed = stored(mixed.select(*rows.columns, "shard", "__place", "__mix", "__bucket"), "shard-dealt")
    before = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = mixed.groupBy("shard", "__bucket").count().select(
        "shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy("shard", "__bucket").orderBy("__mix", "__place")
    return mixed.withColumn("__slot", F.row_number().over(inside) - 1).join(offsets, ["shard", "__bucket"]).select(
        *rows.columns, "shard", (F.col("__slot") + F.col("__offset")).cast("long").alias("slot"))


def _deals(spark, blocks: Sequence[int], matrix: Sequence[Sequence[int]]) -> DataFrame:
    """__block, __upto: the block's rows up to each shard, as literal rows."""
    lines = []
    for block, row in zip(blocks, matrix):
        upto, sums = 0, []
        for n in row:
            upto += n
            sums.append(str(upto))
        lines.append(f"{block}:{','.join(sums)}")
    if not lines:
        return spark.range(0).select(F.col("id").alias("__block"), F.array(F.lit(0).cast("long")).alias("__upto"))
    line = F.split("line", ":")
    return spark.range(1).select(F.explode(F.split(F.lit(";".join(lines)), ";")).alias("line")).select(
        line[0].cast("long").alias("__block"), F.split(line[1], ",").cast("array<long>").alias("__upto"))


def shard_documents(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null) of ``docs`` (doc_id, text).

    size is the text's UTF-8 bytes plus 16; a null text is empty. Only these narrow columns are shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_shards(narrow, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"))
