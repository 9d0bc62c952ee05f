"""Lines of text files with their numbers, and records that span lines, without one task per file.

A file is read in blocks by as many tasks as it has blocks. What depends on everything before a line (its number, whether
it lies inside a quoted field) is a running total: it is added up inside each stretch of up to 65,536 lines of a block, and one
row a stretch carries the totals of the stretches before it. The same holds for compressed files, which are one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

_STRETCH = ["__file", "__block", "__stretch"]


def text_lines(spark: SparkSession, paths, encoding: str = "UTF-8") -> DataFrame:
    """The lines of files as ``value``, to the byte but for the line feed (a carriage return before it stays), with the
    place they were read from: file, block and a number that grows along the block."""
    raw = spark.read.option("lineSep", "\n").option("encoding", encoding).text(paths)
    return raw.select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                      F.monotonically_increasing_id().alias("__place"))


def running_along_files(lines: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """``lines`` (from ``text_lines``, with any columns added) with inclusive running sums of columns along each file.

    Lines are shuffled once, by stretch (the high bits of their place), so that no task holds a whole block. The sums per stretch
    are taken from that same shuffle (whole rows on both sides), so that both see one reading of the files: another
    one could cut them into other blocks. One row a stretch is ordered per file.
    """
    amounts = {f"__a_{name}": amount.cast("long") for name, amount in totals.items()}
    place = F.shiftright("__place", 16).alias("__stretch")
    parts = lines.select("*", place, *[a.alias(n) for n, a in amounts.items()]).repartition(*_STRETCH)
    inside = W.partitionBy(*_STRETCH).orderBy("__place").rowsBetween(W.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(f"__a_{name}").over(inside).alias(f"__i_{name}") for name in totals])
    blocks = parts.groupBy(*_STRETCH).agg(*[F.sum(n).alias(n) for n in amounts], F.max(F.struct("__place", *parts.columns)).alias("__last"))
    before = W.partitionBy("__file").orderBy("__block", "__stretch").rowsBetween(W.unboundedPreceding, -1)
    carry = blocks.where("__last is not null").select(
        *_STRETCH, *[F.coalesce(F.sum(f"__a_{name}").over(before), F.lit(0)).alias(f"__c_{name}") for name in totals])
    kept = [F.col(c) for c in lines.columns]
    return local.join(carry, _STRETCH).select(*kept, *[(F.col(f"__i_{name}") + F.col(f"__c_{name}")).alias(name) for name in totals])


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``line_number``, from 1 in each file."""
    return running_along_files(lines, {"line_number": F.lit(1)})


def records(spark: SparkSession, paths, *, quote: str = '"', skip_header: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """Records of delimited files whose quoted fields may hold line breaks: __file, line_number (of the first line), value.

    A line with an odd number of quotes opens or closes a field that goes on over a line break; the number of
    such lines before a line tells whether it is inside one. Lines that are records are left where they are; only those of
    longer records are brought together. Quotes must stand around fields or doubled inside them; a lone quote inside an
    unquoted field opens one here. ``skip_header`` leaves out the first record of each file; blank lines are left out.
    """
    odd = F.length(F.regexp_replace("value", f"[^{quote}]", "")) % 2
    lines = running_along_files(text_lines(spark, paths, encoding).withColumn("__odd", odd), {"line_number": F.lit(1), "__upto": F.col("__odd")})
    whole = lines.where("__odd = 0 and __upto % 2 = 0").select("__file", "line_number", "value")
    # the odd lines pair up: a record that begins with odd line 2k + 1 ends with odd line 2k + 2
    long = lines.where("not (__odd = 0 and __upto % 2 = 0)").groupBy("__file", F.expr("(__upto + 1) div 2").alias("__record")).agg(
        F.min("line_number").alias("line_number"), F.expr("listagg(value, '\n') within group (order by line_number)").alias("value"))
    out = whole.unionByName(long.drop("__record")).where(~F.col("value").rlike("^[\\x00-\\x20]*$"))
    return out.where("line_number > 1") if skip_header else out
