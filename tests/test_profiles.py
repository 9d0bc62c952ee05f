"""Profiles from footers against full scans, and stored sketches against exact counts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import sketches
from fleetgauge.session import shared_dir
from fleetgauge.sources import footers


@pytest.fixture(scope="module")
def stored(spark):
    """A table in order of its id, with NULLs, texts, times and lists, in several files and row groups."""
    path = shared_dir(spark, "t-footers")
    n = F.col("id")
    df = spark.range(5000).select(
        n, F.when(n % 7 > 0, n % 100).cast("double").alias("part"), F.concat(F.lit("t"), n % 13).alias("text"),
        F.timestamp_seconds(n * 60).cast("timestamp_ntz").alias("at"), F.date_add(F.lit(dt.date(2024, 1, 1)), (n % 30).cast("int")).alias("day"), F.array(n, n).alias("pair"))
    df.repartitionByRange(5, "id").sortWithinPartitions("id").write.option("parquet.block.size", "20000").option("parquet.page.size", "2000").parquet(path)
    return path, spark.read.parquet(path)


def test_footers_equal_a_full_scan(spark, stored):
    path, df = stored
    feet = footers.parquet_footers(spark, [path])
    cost = {r["column"]: r for r in footers.column_cost(feet).collect()}
    for c in ("id", "part", "at", "day"):
        us = df.select(F.col(c).cast("double") if c in ("id", "part") else F.unix_micros(F.col(c).cast("timestamp")).cast("double")).toDF("v")
        n, low, high = us.agg(F.count("v"), F.min("v"), F.max("v")).first()
        r = cost[c]
        assert (r["n_values"] - r["n_nulls"], r["low"], r["high"]) == (n, low, high)
    assert cost["pair.list.element"]["n_values"] == 10000 and cost["text"]["low"] is None
    assert abs(sum(r["pct_of_table"] for r in cost.values()) - 100) < 0.01
    skew = footers.file_skew(feet).first()
    per = [r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]
    assert (skew["files"], skew["rows"], skew["min_rows"], skew["max_rows"]) == (len(per), 5000, min(per), max(per))


def test_groups_a_range_reads(spark, stored):
    path, df = stored
    feet = footers.parquet_footers(spark, [path])
    read = footers.groups_to_read(feet, "id", low=1000, high=1100).first()
    inside = df.where("id between 1000 and 1100").count()
    assert inside <= read["read_rows"] < 5000 and read["read_groups"] < read["row_groups"] and read["rows"] == 5000
    every = footers.groups_to_read(feet, "part", low=50, high=60).first()
    assert every["read_groups"] == every["row_groups"]                # not in order of it
    assert footers.groups_to_read(feet, "id", low=9999).first()["read_rows"] == 0
    assert footers.groups_to_read(feet, "text", low=1).first()["read_rows"] == 5000      # no bounds known: read


def test_no_files(spark, tmp_path):
    feet = footers.parquet_footers(spark, [str(tmp_path), str(tmp_path / "none")])
    assert feet.count() == 0 and footers.column_cost(feet).count() == 0 and footers.file_skew(feet).count() == 0


def test_merged_days_within_the_stated_error(spark):
    """Half of all rows are one user's; days overlap in their users."""
    log = spark.range(60000).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.xxhash64("id") % 9000).alias("user"), F.col("id").alias("row"), (F.col("id") % 3).alias("kind"),
        F.timestamp_seconds(F.col("id") * 20).cast("timestamp_ntz").alias("ts"))
    path = shared_dir(spark, "t-sketches")
    sketches.daily_sketches(log, "user", "ts", keys=["kind"]).write.parquet(path)
    days = spark.read.parquet(path)
    for start, end in ((None, None), ("1970-01-03", "1970-01-09"), ("1970-01-05", None)):
        inside = log.where((F.col("ts") >= F.lit(start or "1970-01-01").cast("timestamp_ntz")) & (F.to_date("ts") <= F.lit(end or "2000-01-01").cast("date")))
        exact = {r["kind"]: (r["n"], r["d"]) for r in inside.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("user").alias("d")).collect()}
        got = {r["kind"]: (r["n"], r["n_distinct"]) for r in sketches.merged_distinct(days, keys=["kind"], start=start, end=end).collect()}
        assert got.keys() == exact.keys() and all(got[k][0] == n and abs(got[k][1] - d) <= 3 * sketches.relative_error() * d for k, (n, d) in exact.items())
    assert sketches.merged_distinct(days.limit(0)).first()["n_distinct"] in (None, 0)
    assert sketches.relative_error(14) < sketches.relative_error(10)
