"""Interval histories of snapshots: against a plain walk over the days, merged day by day, and as of an instant."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import history
from fleetgauge.session import shared_dir

DAY = [dt.datetime(2024, 1, d) for d in range(1, 9)]
SCHEMA = "cluster_id string, snapshot_ts timestamp_ntz, name string, fingerprint string"
CLOCK = "cluster_id string, snapshot_ts timestamp_ntz"


def walk(seed):
    """Two clusters with days of their own; objects appear, change, vanish and come back. One day shows no object."""
    rng = random.Random(seed)
    taken = {"a": DAY[:7], "b": [DAY[0], DAY[2], DAY[3], DAY[6]]}
    rows = []
    for cluster, days in taken.items():
        state = {}
        for day in days:
            for name in "pqrstu":
                change = rng.random()
                if change < 0.2:
                    state.pop(name, None)
                elif change < 0.5:
                    state[name] = rng.choice(["x", "y", None])
            if not (cluster == "a" and day == DAY[4]):
                rows += [(cluster, day, n, f) for n, f in state.items()]
    return rows, [(c, d) for c, days in taken.items() for d in days]


def plain_history(rows, clock):
    seen = {(c, d, n): f for c, d, n, f in rows}
    out = []
    for cluster in {c for c, _ in clock}:
        days = sorted(d for c, d in clock if c == cluster)
        for name in {n for c, _, n in seen if c == cluster}:
            held = None
            for day in days + [None]:
                there = (cluster, day, name) in seen
                if held and (not there or seen[cluster, day, name] != held[0]):
                    out.append((cluster, name, held[0], held[1], day, held[2]))
                    held = None
                if there:
                    held = (seen[cluster, day, name], held[1] if held else day, held[2] + 1 if held else 1)
    return Counter(out)


def collected(df):
    return Counter(tuple(r) for r in df.select("cluster_id", "name", "fingerprint", "valid_from", "valid_to", "n_snapshots").collect())


def frames(spark, seed):
    rows, times = walk(seed)
    clock = spark.createDataFrame(times, CLOCK)
    return rows, times, spark.createDataFrame(rows, SCHEMA), history.snapshot_clock(clock)




@pytest.mark.parametrize("seed", [1, 2, 3])
def test_history_against_a_walk(spark, seed):
    rows, times, snapshots, clock = frames(spark, seed)
    assert collected(history.interval_history(snapshots, ["name"], clock=clock)) == plain_history(rows, times)
    shown = sorted({(c, d) for c, d, _, _ in rows})                    # without a clock: snapshots that show something
    assert collected(history.interval_history(snapshots, ["name"])) == plain_history(rows, shown)


def test_merging_days_equals_building_anew(spark):
    rows, times, snapshots, clock = frames(spark, 4)
    grown = history.interval_history(snapshots.limit(0), ["name"])
    for day in DAY[:7]:
        taken = spark.createDataFrame([t for t in times if t[1] == day], CLOCK)
        grown = history.merge_snapshot(grown, snapshots.where(F.col("snapshot_ts") == F.lit(day)), ["name"], clock=taken)
        grown = spark.createDataFrame(grown.collect(), grown.schema)     # a plan of its own for every day
    assert collected(grown) == plain_history(rows, times)


def test_stored_history(spark):
    rows, times, snapshots, clock = frames(spark, 5)
    path = shared_dir(spark, "t-history")
    add = lambda day: history.append_snapshot(snapshots.where(F.col("snapshot_ts") == F.lit(day)), path, ["name"], day,
                                              clock=spark.createDataFrame([t for t in times if t[1] == day], CLOCK))
    for day in DAY[:4]:
        grown = add(day)
    before = collected(grown)
    # a merge that died: its ended rows are there, its standing rows are not complete
    spark.range(3).write.parquet(f"{path}/ended/{history._version(DAY[4])}")
    assert collected(history.read_history(spark, path, grown.schema.simpleString()[7:-1].replace(":", " "))) == before
    for day in DAY[4:7]:
        grown = add(day)
    assert collected(grown) == plain_history(rows, times)
    with pytest.raises(ValueError):
        add(DAY[6])


def test_as_of_and_at(spark):
    rows, times, snapshots, clock = frames(spark, 6)
    known = history.interval_history(snapshots, ["name"], clock=clock)
    for instant in (DAY[0], DAY[4], DAY[3] + dt.timedelta(hours=5), dt.datetime(2023, 1, 1), dt.datetime(2030, 1, 1)):
        want = Counter()
        for cluster in "ab":
            upto = [d for c, d in times if c == cluster and d <= instant]
            want.update((c, n, f) for c, d, n, f in rows if upto and c == cluster and d == max(upto))
        got = history.state_as_of(known, instant).select("cluster_id", "name", "fingerprint").collect()
        assert Counter(map(tuple, got)) == want
        events = spark.createDataFrame([(c, n, instant, 7) for c in "ab" for n in "pqrstu"], "cluster_id string, name string, ts timestamp_ntz, extra int")
        found = history.state_at(events, known, ["name"], "ts").where("valid_from is not null").select("cluster_id", "name", "fingerprint").collect()
        assert Counter(map(tuple, found)) == want


def test_changes(spark):
    rows, times, snapshots, clock = frames(spark, 7)
    known = history.interval_history(snapshots, ["name"], clock=clock)
    want = Counter()
    seen = {(c, d): {n: f for cc, dd, n, f in rows if (cc, dd) == (c, d)} for c, d in times}
    for cluster in "ab":
        days = sorted(d for c, d in times if c == cluster)
        for before, now in zip(days, days[1:]):
            a, b = seen[cluster, before], seen[cluster, now]
            want.update((cluster, n, now, "created", None, b[n]) for n in b.keys() - a.keys())
            want.update((cluster, n, now, "dropped", a[n], None) for n in a.keys() - b.keys())
            want.update((cluster, n, now, "changed", a[n], b[n]) for n in a.keys() & b.keys() if a[n] != b[n])
    got = history.changes(known, ["name"], clock=clock).select("cluster_id", "name", "at", "change", "before", "after").collect()
    assert Counter(map(tuple, got)) == want
    days = {(r["cluster_id"], r["day"]): (r["created"], r["changed"], r["dropped"]) for r in history.drift_by_day(known, ["name"], clock=clock).collect()}
    assert days == {(c, at.date()): tuple(sum(k for (cc, _, aa, what, _, _), k in want.items() if (cc, aa, what) == (c, at, kind))
                                          for kind in ("created", "changed", "dropped")) for c, _, at, *_ in want}


def test_only_standing_rows_meet_a_snapshot(spark):
    """Rows that have ended are not shuffled by a merge."""
    path = shared_dir(spark, "t-ended")
    _, _, snapshots, clock = frames(spark, 8)
    history.interval_history(snapshots, ["name"], clock=clock).write.parquet(path)
    stored = spark.read.parquet(path)
    merged = history.merge_snapshot(stored, snapshots.where(F.col("snapshot_ts") == F.lit(DAY[0])).withColumn("snapshot_ts", F.lit(DAY[7])), ["name"])
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    ended = [line for line in plan.split("\n") if "isnotnull(valid_to" in line]
    assert ended and plan.startswith("Union")
