"""Connected components by alternating stars, with written tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (a, b); both of type long.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest
    neighbour, which shortens all paths; the rounds end when a round changes nothing. A node's neighbours are
    only reduced to their minimum, never gathered. No edges give no rows; loops and repeats are harmless.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    parts, state = 1 + edges.count() // 200_000, None       # few edges need few files; stars have no more edges than the graph
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # larger neighbours go to the smallest one
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = stored(large.coalesce(parts), "large")
        # smaller neighbours (and the node) go to the smallest one; here a > b always
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
                 .union(floor.select("a", F.col("m").alias("b"))).distinct())
        edges = stored(small.coalesce(parts), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
