"""Chunked computations against brute force, with one key holding a third and more of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 or i % 7 == 0 else f"k{rng.randrange(40)}"
        value = 0 if rng.random() < 0.2 else rng.choice([rng.randrange(50), rng.randrange(10 ** 9)])
        data.append((key, i, rng.randrange(100000), value))
    return data, spark.createDataFrame(data, "key string, id int, t int, v long").repartition(6)


def groups(data):
    out = {}
    for key, i, t, v in data:
        out.setdefault(key, []).append((t, i, v))
    return {k: sorted(x) for k, x in out.items()}


def test_running_total(skewed):
    data, df = skewed
    got = {r.id: (r.run, r.all) for r in ordered.running_total(
        df, ["key"], ["t", "id"], F.floor(F.col("t") / 500), {"run": "v"}, {"all": "v"}).collect()}
    for rows in groups(data).values():
        total, whole = 0, sum(r[2] for r in rows)
        for t, i, v in rows:
            total += v
            assert got[i] == (total, whole)
    assert len(got) == len(data)


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbour(skewed, ahead):
    data, df = skewed
    got = {r.id: r.near for r in ordered.neighbour(
        df, ["key"], ["t", "id"], F.floor(F.col("t") / 500), {"near": "id"}, ahead=ahead).collect()}
    for rows in groups(data).values():
        ids = [r[1] for r in rows]
        for n, i in enumerate(ids):
            other = n + 1 if ahead else n - 1
            assert got[i] == (ids[other] if 0 <= other < len(ids) else None)


def quantile(values, p):
    values = sorted(values)
    rank = (len(values) - 1) * p
    lo = int(rank)
    hi = min(lo + 1, len(values) - 1)
    return values[lo] + (values[hi] - values[lo]) * (rank - lo)


@pytest.mark.parametrize("fn", [ordered.exact_quantiles, ordered.exact_quantiles_few_groups])
def test_quantiles(skewed, fn):
    data, df = skewed
    got = {r.key: r for r in fn(df.withColumn("v", F.col("v") - 20), ["key"], "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()}
    for key, rows in groups(data).items():
        values = [r[2] - 20 for r in rows]
        for name, p in (("p0", 0.0), ("p50", 0.5), ("p99", 0.99), ("p100", 1.0)):
            assert got[key][name] == pytest.approx(quantile(values, p), rel=1e-12)


def test_band_mean_equals_ntile(skewed):
    data, df = skewed
    cells = df.groupBy("key", "v").agg(F.count("*").alias("n"))
    ranked = ordered.running_total(cells, ["key"], ["v"], ordered.magnitude_bucket(F.col("v")), {"upto": "n"}, {"total": "n"})
    cell = [F.col(c) for c in ("v", "n", "upto", "total")]
    got = {r.key: r for r in ranked.groupBy("key").agg(
        ordered.band_mean(*cell, 6, 15, 20).alias("mid"), ordered.band_mean(*cell, 20, 20, 20).alias("top")).collect()}
    for key, rows in groups(data).items():
        values = sorted(r[2] for r in rows)
        small, big = divmod(len(values), 20)
        tile, at = {}, 0
        for t in range(1, 21):
            size = small + (t <= big)
            tile[t] = values[at:at + size]
            at += size
        for name, wanted in (("mid", range(6, 16)), ("top", [20])):
            inside = [v for t in wanted for v in tile[t]]
            assert got[key][name] == (pytest.approx(sum(inside) / len(inside)) if inside else None)


def test_bucket_never_decreases(spark):
    df = spark.range(-2000, 2000).select((F.col("id") * F.abs(F.col("id")) / 7).alias("v"))
    buckets = [r[0] for r in df.orderBy("v").select(ordered.magnitude_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets)


def test_covered(spark):
    rng = random.Random(3)
    spans = [(s, s + rng.randrange(0, 4000)) for s in (rng.randrange(200000) for _ in range(40))]
    instants = [(n, rng.randrange(200000)) for n in range(800)] + [(900, spans[0][0]), (901, spans[0][1])]
    stamp = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    i = spark.createDataFrame(instants, "n int, s long").select("n", stamp("s").alias("at"))
    w = spark.createDataFrame(spans, "a long, b long").select(stamp("a").alias("lo"), stamp("b").alias("hi"))
    got = {r.n for r in ordered.covered(i, "at", w, "lo", "hi").collect()}
    assert got == {n for n, s in instants if any(a <= s <= b for a, b in spans)}


def test_hot_group_is_spread(spark):
    """Rows of one group meet in chunks only: no shuffle key is the group alone for whole rows."""
    df = spark.range(1000).select(F.lit("hot").alias("key"), F.col("id").alias("t"), F.lit(1).alias("v"))
    plan = ordered.running_total(df, ["key"], ["t"], F.floor(F.col("t") / 10), {"run": "v"})._jdf.queryExecution().executedPlan().toString()
    alone = [line for line in plan.splitlines() if "hashpartitioning(key" in line and "__chunk" not in line]
    assert len(alone) <= 1          # the per-chunk summary
