"""History of catalog objects over snapshots: one row for each stretch of snapshots in which an object stayed the same.

A history has the object's keys, ``fingerprint``, ``valid_from`` (first snapshot of the stretch), ``valid_to`` (the
first one after it, NULL while the object still stands like that) and ``n_snapshots``. An object's rows do not overlap;
where it was absent from snapshots of its cluster there is a gap. Snapshots may come at different times in
every cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .catalog import FLEET


def fingerprinted(texts: DataFrame, keys: Sequence[str], text: str = "ddl", order: Sequence[str] = ()) -> DataFrame:
    """One fingerprint per object from one or several texts (in ``order``, else in their own)."""
    lines = F.array_sort(F.collect_list(F.struct(*order, text)))
    return texts.groupBy(*keys).agg(F.md5(F.array_join(F.transform(lines, lambda r: r[text]), "\n")).alias("fingerprint"))


def _same(keys: Sequence[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def snapshot_clock(snapshots: DataFrame, *, fleet: Sequence[str] = FLEET, at: str = "snapshot_ts") -> DataFrame:
    """The snapshots taken in each cluster: fleet keys, ``at``, its number and the time of the next one."""
    along = W.partitionBy(*fleet).orderBy(at)
    return snapshots.select(*fleet, at).distinct().select(*fleet, at, F.row_number().over(along).alias("tick"), F.lead(at).over(along).alias("next_ts"))


def interval_history(snapshots: DataFrame, keys: Sequence[str], *, fleet: Sequence[str] = FLEET, at: str = "snapshot_ts",
                     clock: DataFrame | None = None) -> DataFrame:
    """The history of objects (``fleet`` and ``keys``) from all their snapshots, one row an object and snapshot.

    ``clock`` (as from ``snapshot_clock``) tells of snapshots that show no object at all; without it, every snapshot
    that shows any counts. Windows run over one object's snapshots, so no group grows with the number of objects.
    """
    fleet, keys = list(fleet), list(keys)
    clock = snapshot_clock(snapshots, fleet=fleet, at=at) if clock is None else clock
    seen = snapshots.select(*fleet, at, *keys, "fingerprint").join(clock, [*fleet, at])
    along = W.partitionBy(*fleet, *keys).orderBy("tick")
    goes_on = (F.lag("tick").over(along) == F.col("tick") - 1) & F.lag("fingerprint").over(along).eqNullSafe(F.col("fingerprint"))
    begun = seen.withColumn("__begins", F.when(goes_on, 0).otherwise(1))
    stretch = begun.withColumn("__stretch", F.sum("__begins").over(along.rowsBetween(W.unboundedPreceding, 0)))
    return stretch.groupBy(*fleet, *keys, "__stretch").agg(
        F.max("fingerprint").alias("fingerprint"), F.min(at).alias("valid_from"), F.max_by("next_ts", "tick").alias("valid_to"),
        F.count("*").alias("n_snapshots")).drop("__stretch")


def merge_snapshot(history: DataFrame, snapshot: DataFrame, keys: Sequence[str], *, fleet: Sequence[str] = FLEET, at: str = "snapshot_ts",
                   clock: DataFrame | None = None) -> DataFrame:
    """The history after one further snapshot of some clusters, later than all they have had.

    Only rows that still stand in those clusters meet the snapshot; all others go through as they are, without a shuffle.
    Clusters without a snapshot, or not in ``clock`` (fleet keys and ``at``), stay as they are.
    """
    fleet, keys = list(fleet), list(keys)
    columns = [*fleet, *keys, "fingerprint", "valid_from", "valid_to", "n_snapshots"]
    taken = (snapshot if clock is None else clock).select(*fleet, F.col(at).alias("__at")).distinct()
    history = history.select(*columns)
    marked = history.where("valid_to is null").join(taken, fleet, "left")
    now = snapshot.select(*fleet, *keys, "fingerprint", F.col(at).alias("__now"))
    met = marked.where("__at is not null").alias("h").join(now.alias("s"), _same(fleet + keys, "h", "s"), "full_outer")
    old, new = F.col("h.valid_from").isNotNull(), F.col("s.__now").isNotNull()
    stays = old & new & F.col("h.fingerprint").eqNullSafe(F.col("s.fingerprint"))
    row = lambda side, start, end, n: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in [*fleet, *keys, "fingerprint"]], start.alias("valid_from"),
                                               end.cast(history.schema["valid_to"].dataType).alias("valid_to"), n.cast("long").alias("n_snapshots"))
    kept = row("h", F.col("h.valid_from"), F.when(stays, None).otherwise(F.col("h.__at")), F.col("h.n_snapshots") + F.when(stays, 1).otherwise(0))
    fresh = row("s", F.col("s.__now"), F.lit(None), F.lit(1))
    after = met.select(F.inline(F.filter(F.array(F.when(old, kept), F.when(new & ~stays, fresh)), lambda r: r.isNotNull())))
    return history.where("valid_to is not null").unionByName(marked.where("__at is null").drop("__at")).unionByName(after)


def state_as_of(history: DataFrame, instant) -> DataFrame:
    """The objects as they stood at an instant; both bounds compare raw columns and reach the file scan."""
    t = F.lit(str(instant)).cast("timestamp_ntz")
    return history.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def state_at(events: DataFrame, history: DataFrame, keys: Sequence[str], ts: str, *, fleet: Sequence[str] = FLEET) -> DataFrame:
    """``events`` with the ``fingerprint`` and ``valid_from`` of their object at their time; NULL where it did not exist.

    An equi-join on the object with the interval as a further condition: an object has few stretches, and no two hold
    one instant, so no event is multiplied.
    """
    on = [*fleet, *keys]
    h = history.select(*on, "fingerprint", "valid_from", "valid_to")
    e, h = events.alias("e"), h.alias("h")
    held = reduce(lambda a, b: a & b, [F.col(f"e.{k}") == F.col(f"h.{k}") for k in on])
    held = held & (F.col(f"e.{ts}") >= F.col("h.valid_from")) & (F.col("h.valid_to").isNull() | (F.col(f"e.{ts}") < F.col("h.valid_to")))
    return e.join(h, held, "left").select("e.*", "h.fingerprint", "h.valid_from")


def changes(history: DataFrame, keys: Sequence[str], *, fleet: Sequence[str] = FLEET, clock: DataFrame | None = None) -> DataFrame:
    """Every change as a row: fleet keys, object keys, ``at``, ``change`` (created, changed, dropped), fingerprint before and after.

    Objects of a cluster's first snapshot (from ``clock``, else the earliest ``valid_from``) are found, not created: no rows.
    """
    fleet, keys = list(fleet), list(keys)
    along = W.partitionBy(*fleet, *keys).orderBy("valid_from")
    first = (history.groupBy(*fleet).agg(F.min("valid_from").alias("__first")) if clock is None
             else clock.where("tick = 1").select(*fleet, F.col("snapshot_ts").alias("__first")))
    rows = history.select("*", F.lag(F.struct("valid_to", "fingerprint")).over(along).alias("__was"), F.lead("valid_from").over(along).alias("__then"))
    rows = rows.join(first, fleet)
    follows = F.coalesce(F.col("__was.valid_to") == F.col("valid_from"), F.lit(False))
    none = F.lit(None).cast("string")
    event = lambda at, what, before, now: F.struct(at.alias("at"), what.alias("change"), before.alias("before"), now.alias("after"))
    began = F.when(F.col("valid_from") > F.col("__first"), event(
        F.col("valid_from"), F.when(follows, "changed").otherwise("created"), F.when(follows, F.col("__was.fingerprint")), F.col("fingerprint")))
    gone = F.col("valid_to").isNotNull() & ~F.coalesce(F.col("__then") == F.col("valid_to"), F.lit(False))
    ended = F.when(gone, event(F.col("valid_to"), F.lit("dropped"), F.col("fingerprint"), none))
    return rows.select(*fleet, *keys, F.inline(F.filter(F.array(began, ended), lambda e: e.isNotNull())))


def drift_by_day(history: DataFrame, keys: Sequence[str], *, fleet: Sequence[str] = FLEET, clock: DataFrame | None = None) -> DataFrame:
    """Number of objects created, changed and dropped per cluster and day."""
    return changes(history, keys, fleet=fleet, clock=clock).groupBy(*fleet, F.to_date("at").alias("day")).agg(
        *[F.count_if(F.col("change") == kind).alias(kind) for kind in ("created", "changed", "dropped")])


# ---- a stored history, grown by a snapshot at a time
def _version(at) -> str:
    return "".join(c for c in str(at) if c.isdigit())


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Versions whose standing rows are written whole, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/standing")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    done = lambda name: system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/standing/{name}/_SUCCESS"))
    return sorted(name for name in names if name.isdigit() and done(name))


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored history: the newest version's standing rows and all rows that ended up to it."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    ended = [f"{path}/ended/{v}" for v in versions]
    return spark.read.schema(schema).parquet(f"{path}/standing/{versions[-1]}", *ended)


def append_snapshot(snapshot: DataFrame, path: str, keys: Sequence[str], taken_at, *, fleet: Sequence[str] = FLEET, at: str = "snapshot_ts",
                    clock: DataFrame | None = None) -> DataFrame:
    """Merge a further snapshot into the history stored at ``path``, and return the history.

    ``taken_at`` names the version; versions have to grow. Rows that have ended are written once and never read again by
    a merge: a version adds the rows that ended with it, then writes the standing rows, whose completion makes
    the version valid. A merge that dies before is simply done again; readers meanwhile see the version before.
    """
    spark, version = snapshot.sparkSession, _version(taken_at)
    done = _versions(spark, path)
    columns = [*fleet, *keys]
    types = snapshot.schema
    schema = ", ".join([*[f"`{c}` {types[c].dataType.simpleString()}" for c in columns], "fingerprint string", f"valid_from {types[at].dataType.simpleString()}",
                        f"valid_to {types[at].dataType.simpleString()}", "n_snapshots bigint"])
    if done and done[-1] >= version:
        raise ValueError(f"the history already reaches {done[-1]}")
    standing = spark.read.schema(schema).parquet(f"{path}/standing/{done[-1]}") if done else spark.createDataFrame([], schema)
    merged = merge_snapshot(standing, snapshot, keys, fleet=fleet, at=at, clock=clock)
    merged.where("valid_to is not null").write.mode("overwrite").parquet(f"{path}/ended/{version}")
    merged.where("valid_to is null").write.mode("overwrite").parquet(f"{path}/standing/{version}")
    return read_history(spark, path, schema)
