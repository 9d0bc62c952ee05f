"""Order-dependent computations that never bring one whole group into one task.

Each helper cuts a group into order-preserving chunks, works inside (group, chunk), and carries
a small per-chunk summary forward. Only the summaries of a group meet in one task, so a group
holding a third of all rows is still spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# 2**10 buckets per power of two: a bucket spans about 0.07 % of its values' magnitude
_BUCKETS_PER_OCTAVE = 1024


def magnitude_bucket(v: Column) -> Column:
    """A coarse bucket number that never decreases when ``v`` grows."""
    v = v.cast("double")
    size = F.floor(F.log2(F.abs(v) + 1.0) * _BUCKETS_PER_OCTAVE).cast("long")
    return F.when(v < 0, -size).otherwise(size)


def _chunked(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Rows with their chunk. The NULL test is spelled out because a join on these columns adds it
    to one side only, and two sides that differ cannot share a scan or shuffle."""
    df = df.withColumn("__chunk", chunk)
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "__chunk"]]))


def running_total(df: DataFrame, keys: Sequence[str], pos: Sequence[str], chunk: Column,
                  values: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """Add inclusive running sums along the ``pos`` columns: ``values`` maps output to summed column.

    ``totals`` maps output names to columns whose sum over the whole group is added as well.
    ``pos`` must be unique within a group (aggregate first); ``chunk`` must not decrease as
    ``pos`` grows. ``keys`` must not be NULL.
    """
    keys, totals = list(keys), totals or {}
    parts = _chunked(df, keys, chunk)
    summed = sorted({*values.values(), *totals.values()})
    per_chunk = parts.groupBy(*keys, "__chunk").agg(*[F.sum(c).alias(f"__s_{c}") for c in summed])
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = per_chunk.select(
        *keys, "__chunk",
        *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__c_{o}") for o, c in values.items()],
        *[F.sum(f"__s_{c}").over(W.partitionBy(*keys)).alias(o) for o, c in totals.items()],
    )
    inside = W.partitionBy(*keys, "__chunk").orderBy(*pos).rowsBetween(W.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(c).over(inside).alias(f"__l_{o}") for o, c in values.items()])
    joined = local.join(carry, [*keys, "__chunk"])
    return joined.select(*df.columns, *[(F.col(f"__l_{o}") + F.col(f"__c_{o}")).alias(o) for o in values], *totals)


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
              cols: dict[str, str], ahead: bool = False) -> DataFrame:
    """Add columns of the previous (or, with ``ahead``, next) row of the group.

    ``cols`` maps output name to source column. ``order`` should be a total order; ``chunk`` must
    not decrease along it. ``keys`` must not be NULL.
    """
    keys, order = list(keys), list(order)
    parts = _chunked(df, keys, chunk).repartition(*keys, "__chunk")
    place = F.struct(*order)
    row = F.struct(*[F.col(c).alias(o) for o, c in cols.items()])
    sort = [F.col(c).desc() if ahead else F.col(c).asc() for c in order]
    inside = W.partitionBy(*keys, "__chunk").orderBy(*sort)
    local = parts.select("*", F.lag(row).over(inside).alias("__near"), F.row_number().over(inside).alias("__rn"))
    # whole rows, so that both sides read the very same shuffle
    edge = parts.groupBy(*keys, "__chunk").agg((F.min_by if ahead else F.max_by)(F.struct(*df.columns), place).alias("__edge"))
    across = W.partitionBy(*keys).orderBy(F.col("__chunk").desc() if ahead else F.col("__chunk").asc())
    far = F.struct(*[F.col("__edge")[c].alias(o) for o, c in cols.items()])
    edge = edge.select(*keys, "__chunk", F.lag(far).over(across).alias("__far"))
    near = F.when(F.col("__rn") == 1, F.col("__far")).otherwise(F.col("__near"))
    return local.join(edge, [*keys, "__chunk"]).select(*df.columns, *[near[o].alias(o) for o in cols])


def _targets(probs: dict[str, float], total: Column) -> dict[str, tuple[Column, Column, Column]]:
    """Zero-based ranks around each wanted quantile, and the share of the way between them."""
    out = {}
    for o, p in probs.items():
        rank = (total - 1) * F.lit(float(p))
        lo = F.floor(rank).cast("long")
        out[o] = (lo, F.ceil(rank).cast("long"), rank - lo)
    return out


def _interpolated(ranked: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles from values covering the ranks ``upto - n`` .. ``upto - 1`` of ``total``."""
    first, last, v = F.col("upto") - F.col("n"), F.col("upto") - 1, F.col(value).cast("double")
    aggs = []
    for o, (lo, hi, share) in _targets(probs, F.col("total")).items():
        aggs += [F.max(F.when((first <= lo) & (lo <= last), v)).alias(f"__lo_{o}"),
                 F.max(F.when((first <= hi) & (hi <= last), v)).alias(f"__hi_{o}"), F.max(share).alias(f"__f_{o}")]
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *[
        (F.col(f"__lo_{o}") + (F.col(f"__hi_{o}") - F.col(f"__lo_{o}")) * F.col(f"__f_{o}")).alias(o) for o in probs])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group: ``probs`` maps output name to probability.

    Distinct values are counted before the shuffle and ranked by a chunked running total, instead
    of holding one value map per group. Works for any number of groups.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = running_total(counts, keys, [value], magnitude_bucket(F.col(value)), {"upto": "n"}, {"total": "n"})
    return _interpolated(ranked, keys, value, probs)


def exact_quantiles_few_groups(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The same quantiles where the number of groups is known to be small (a fixed set of metrics).

    A first pass counts values per magnitude bucket and finds the buckets the wanted ranks fall in:
    at most two per quantile and group. A second pass shuffles only the values inside those buckets.
    """
    keys = list(keys)
    df = df.where(F.col(value).isNotNull()).select(*keys, value, magnitude_bucket(F.col(value)).alias("__bucket"))
    along = W.partitionBy(*keys).orderBy("__bucket")
    hist = df.groupBy(*keys, "__bucket").agg(F.count("*").alias("m")).select(
        *keys, "__bucket", "m", F.sum("m").over(along).alias("to"), F.sum("m").over(W.partitionBy(*keys)).alias("total"))
    first, last = F.col("to") - F.col("m"), F.col("to") - 1
    needed = F.lit(False)
    for lo, hi, _ in _targets(probs, F.col("total")).values():
        needed = needed | ((first <= lo) & (lo <= last)) | ((first <= hi) & (hi <= last))
    wanted = hist.where(needed).select(*keys, "__bucket", first.alias("__before"), "total")
    near = df.join(wanted, [*keys, "__bucket"]).groupBy(*keys, "__bucket", "__before", "total", value).agg(F.count("*").alias("n"))
    inside = W.partitionBy(*keys, "__bucket").orderBy(value)
    ranked = near.withColumn("upto", F.col("__before") + F.sum("n").over(inside))
    return _interpolated(ranked, keys, value, probs)


def tile_end(tile: int, total: Column, tiles: int) -> Column:
    """Last one-based rank in NTILE(``tiles``) tile ``tile``; early tiles hold one row more."""
    return F.call_function("div", total, F.lit(tiles)) * tile + F.least(total % tiles, F.lit(tile))


def band_mean(value: Column, n: Column, upto: Column, total: Column, first: int, last: int, tiles: int) -> Column:
    """Mean of the rows falling in tiles ``first``..``last``, from cells of ``n`` equal rows each.

    A cell covers ranks ``upto - n + 1`` .. ``upto``; only its overlap with the band counts.
    """
    overlap = F.greatest(
        F.least(upto, tile_end(last, total, tiles)) - F.greatest(upto - n, tile_end(first - 1, total, tiles)),
        F.lit(0),
    )
    return F.try_divide(F.sum(value * overlap).cast("double"), F.sum(overlap).cast("double"))


def covered(instants: DataFrame, ts: str, spans: DataFrame, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``instants`` whose ``ts`` lies in at least one closed span ``[start, end]`` of the same ``keys``.

    Sweeps span starts and ends along the time axis, in hourly chunks, instead of comparing every
    instant with every span.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    keys = list(keys)
    edges = spans.select(*keys, F.inline(F.array(
        F.struct(us(start).alias("pos"), F.lit(1).alias("delta")),
        F.struct((us(end) + 1).alias("pos"), F.lit(-1).alias("delta")))))
    asked = instants.withColumn("__pos", us(ts))
    marks = asked.select(*keys, F.col("__pos").alias("pos"), F.lit(0).alias("delta"))
    net = edges.unionByName(marks).where("pos is not null").groupBy(*keys, "pos").agg(F.sum("delta").alias("delta"))
    hour = F.call_function("div", F.col("pos"), F.lit(3_600_000_000))
    open_ = running_total(net.withColumn("__axis", F.lit(0)), [*keys, "__axis"], ["pos"], hour, {"level": "delta"})
    inside = open_.where("level > 0").select(*keys, F.col("pos").alias("__pos"))
    return asked.join(inside, [*keys, "__pos"], "left_semi").drop("__pos")
