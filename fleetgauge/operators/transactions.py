"""Commits, table access, conflicts and locks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import rounded
from ..functions.temporal import at, boundary_diff, epoch_us, unset_to_null
from ..functions.text import trimmed
from .rows import catalog_keys, newest, only, recent, told_of, top


def commit_rows(commitlog: DataFrame, fleet: Sequence[str] = ()) -> DataFrame:
    """Commit queue and work milliseconds; a sentinel queue start means the commit never queued."""
    queued_from = F.coalesce(unset_to_null("startqueue"), F.col("startwork"))
    return commitlog.select(*fleet, "xid", unset_to_null("startqueue").alias("startqueue"), "node",
                            boundary_diff("millisecond", queued_from, "startwork").alias("queue_ms"),
                            boundary_diff("millisecond", "startwork", "endtime").alias("commit_ms"), "queuelen")


def commit_stats(commitlog: DataFrame, *, as_of=None, lookback: float | None = None, xid=None, limit: int | None = None,
                 fleet: Sequence[str] = ()) -> DataFrame:
    """Commit queue and work times, longest queue first."""
    rows = commit_rows(only(recent(commitlog, "startwork", as_of, lookback), xid=xid), fleet)
    return top(rows, limit, F.desc("queuelen"), F.desc("queue_ms"), "xid", "node")


LEADER = -1


def table_reads_writes(querylog: DataFrame, scanlog: DataFrame, deletelog: DataFrame, insertlog: DataFrame,
                       conflictlog: DataFrame, utilitytext: DataFrame, commitlog: DataFrame, *, fleet: Sequence[str] = ()) -> DataFrame:
    """What each statement did to which table (R, W, A for aborted) and how its transaction ended."""
    by_query, by_xid = [*fleet, "query"], [*fleet, "xid"]
    touched = lambda log, tag: log.select(*by_query, "tbl", F.lit(tag).alias("operation"))
    conflicts = conflictlog.select(*fleet, F.col("xact_id").alias("xid"), F.col("table_id").alias("tbl")).distinct()
    aborted = querylog.where("aborted = 1").select(*by_query, "xid").join(conflicts, by_xid, "left")
    access = (touched(scanlog.where("type = 2"), "R").unionByName(touched(deletelog, "W")).unionByName(touched(insertlog, "W"))
              .unionByName(touched(aborted, "A")).distinct())
    said = lambda *words: F.lower("text").rlike("|".join(words))
    ended = (utilitytext.where(said("rollback", "aborted")).select(*by_xid, F.lit("R").alias("action"), "endtime")
             .unionByName(utilitytext.where(said("commit", "end")).select(*by_xid, F.lit("C").alias("action"), "endtime"))
             .unionByName(commitlog.where(F.col("node") == LEADER).select(*by_xid, F.lit("C").alias("action"), "endtime"))
             .groupBy(*by_xid).agg(F.max("action").alias("transaction_action"), F.max("endtime").alias("transaction_end")))
    stmts = querylog.select(*by_xid, "query", F.col("starttime").alias("statement_start"), F.col("endtime").alias("statement_end"))
    rows = stmts.join(access, by_query, "left").join(ended, by_xid, "left")
    commits = commitlog.where(F.col("node") == LEADER).select(
        *by_xid, F.lit("C").alias("operation"), unset_to_null("startqueue").alias("statement_start"), F.col("endtime").alias("statement_end"),
        F.col("endtime").alias("transaction_end"), F.lit("C").alias("transaction_action"))
    return rows.unionByName(commits, allowMissingColumns=True).select(
        *by_xid, "query", "tbl", "operation", "statement_start", "statement_end", "transaction_end", "transaction_action")


def object_names(classes: DataFrame, ns: DataFrame, fleet=("cluster_id",)) -> DataFrame:
    """Object id with its trimmed schema and object name."""
    fleet = list(fleet)
    n = ns.select(*fleet, F.col("oid").alias("relnamespace"), trimmed("nspname").alias("schema_name"))
    return classes.join(n, [*fleet, "relnamespace"]).select(*fleet, "oid", "schema_name", trimmed("relname").alias("object_name"), "relowner", "relkind")


def conflicts(conflictlog: DataFrame, classes: DataFrame, ns: DataFrame, *, fleet: Sequence[str] = ()) -> DataFrame:
    """Serialization conflicts with the names of the tables they arose on."""
    names = object_names(classes, ns, catalog_keys(fleet, classes, ns)).select(*fleet, F.col("oid").alias("table_id"), "schema_name", "object_name")
    return conflictlog.join(names, [*fleet, "table_id"]).select(*fleet, "schema_name", "object_name", "xact_id", "process_id", "xact_start_ts", "abort_time")


def conflict_timeline(statementtext: DataFrame, conflictlog: DataFrame | None = None, *, xids=None, fleet: Sequence[str] = ()) -> DataFrame:
    """Statements of the given transactions in time order, or of all that met a conflict."""
    rows = statementtext.select(*fleet, "userid", "xid", "pid", trimmed("label").alias("label"), "starttime", "endtime", "sequence", "type",
                                trimmed("text").alias("text"))
    if xids is not None:
        return only(rows, xid=xids).orderBy("starttime", "xid", "sequence")
    return told_of(rows, conflictlog.withColumnRenamed("xact_id", "xid"), [*fleet, "xid"])


def locks_held(locks: DataFrame, classes: DataFrame, ns: DataFrame, activity: DataFrame, *, fleet: Sequence[str] = ()) -> DataFrame:
    """Locks with the locked object and the user of the locking process."""
    names = object_names(classes, ns, catalog_keys(fleet, classes, ns)).select(*fleet, F.col("oid").alias("relation"), "schema_name", "object_name")
    users = activity.select(*fleet, F.col("procpid").alias("pid"), "usename")
    return locks.join(names, [*fleet, "relation"]).join(users, [*fleet, "pid"]).select(
        *fleet, "schema_name", "object_name", "database", "transaction", "pid", "usename", "mode", "granted")


def _seconds_until(as_of, ts, per: float = 1.0) -> Column:
    return rounded((epoch_us(at(as_of)) - epoch_us(ts)) / (1000000.0 * per), 2)


def blocking_locks(locks: DataFrame, txns: DataFrame, classes: DataFrame, ns: DataFrame, db: DataFrame, recents: DataFrame, *,
                   as_of, fleet: Sequence[str] = ()) -> DataFrame:
    """Locks with how long they are held or waited for and, for granted ones, whom they block.

    Inputs are reduced to a snapshot first: each process's newest transaction per relation, and one
    row per process, relation and mode. Waiters are summed per relation and mode before the join;
    a list of waiters holds each process of the server once at most.
    """
    t = newest(txns.where("lockable_object_type is not null").select(
        *fleet, "pid", "relation", "xid", F.col("txn_owner").alias("user_name"), F.col("lockable_object_type").alias("obj_type"), "txn_start"),
        [*fleet, "pid", "relation"], "txn_start")
    held = locks.select(*fleet, "pid", "relation", "database", "mode", "granted").distinct()
    names = object_names(classes, ns, catalog_keys(fleet, classes, ns)).select(*fleet, F.col("oid").alias("relation"), "schema_name", "object_name")
    d = db.select(*fleet, F.col("oid").alias("database"), trimmed("datname").alias("db_name"))
    r = newest(recents.select(*fleet, "pid", "starttime"), [*fleet, "pid"], "starttime")
    waits = F.when(~F.col("granted"), _seconds_until(as_of, "starttime"))
    snap = (held.join(t, [*fleet, "pid", "relation"]).join(names, [*fleet, "relation"], "left").join(d, [*fleet, "database"], "left")
            .join(r, [*fleet, "pid"], "left")
            .withColumn("waiting_s", waits))
    waiting = snap.where("not granted").groupBy(*fleet, "relation", F.col("mode").alias("waiting_mode")).agg(
        F.expr("listagg(cast(pid as string), ',') within group (order by pid)").alias("pid_list"),
        F.max("waiting_s").alias("max_blocked_s"), F.count("*").alias("n_blocked"))
    blocks = (F.col("mode").like("%Exclusive%")
              | (F.col("mode").like("%Share%") & F.col("waiting_mode").like("%ExclusiveLock") & ~F.col("waiting_mode").like("%Share%")))
    j = snap.alias("l").join(waiting.alias("b"), reduce(
        lambda a, c: a & (F.col(f"l.{c}") == F.col(f"b.{c}")), [*fleet, "relation"], F.col("granted") & blocks), "left")
    held_for = lambda per: F.when(F.col("granted"), _seconds_until(as_of, "txn_start", per))
    return j.select(*[F.col(f"l.{c}").alias(c) for c in fleet], "xid", "pid", "user_name", "db_name", F.col("l.relation").alias("relation"), "schema_name", "object_name", "mode",
                    "granted", "obj_type", "txn_start", held_for(1.0).alias("held_s"), held_for(60.0).alias("held_min"),
                    held_for(3600.0).alias("held_h"), "waiting_s", "max_blocked_s", "n_blocked", "pid_list")


def blocked_by(locks: DataFrame, activity: DataFrame, *, as_of, fleet: Sequence[str] = ()) -> DataFrame:
    """Each waiting lock with the number of processes blocking it and the one blocking longest.

    One row per waiting lock: listing every waiting and blocking pair grows with the square of a
    busy relation's locks, and ``blocking_locks`` already names everyone behind each holder.
    """
    f = list(fleet)
    a = newest(activity.select(*f, "procpid", "usename", "current_query", "query_start"), [*f, "procpid"], "query_start").select(
        *f, F.col("procpid").alias("pid"), F.col("usename").alias("user_name"), F.col("current_query").alias("statement"), "query_start")
    exclusive = F.col("mode").like("%Exclusive%")
    # a holder of an exclusive kind blocks every waiter, a sharing holder only exclusive waiters
    holders = locks.where("granted").groupBy(*f, "relation", "pid").agg(
        F.max(exclusive).alias("blocks_all"), F.max(exclusive | F.col("mode").like("%Share%")).alias("blocks_exclusive")).join(a, [*f, "pid"], "left")
    kinds = holders.select(*f, "relation", "pid", F.struct("query_start", "pid", "user_name", "statement").alias("who"), F.explode(F.filter(F.array(
        F.when(F.col("blocks_all"), F.lit("all")), F.when(F.col("blocks_exclusive"), F.lit("exclusive"))), lambda k: k.isNotNull())).alias("kind"))
    n = kinds.groupBy(*f, "relation", "kind").agg(F.count("*").alias("n_holders"))
    # the two longest holders suffice: a waiter may be one of them itself
    first = W.partitionBy(*f, "relation", "kind").orderBy(F.asc_nulls_last("who.query_start"), "who.pid")
    longest = kinds.withColumn("place", F.row_number().over(first)).where("place <= 2").groupBy(*f, "relation", "kind").agg(
        F.max(F.when(F.col("place") == 1, F.col("who"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("who"))).alias("second"))
    own = kinds.select(*f, "relation", "kind", "pid", F.lit(1).alias("self"))
    kind = F.when(F.col("mode").like("%ExclusiveLock") & ~F.col("mode").like("%Share%"), "exclusive").otherwise("all")
    waiting = locks.where("not granted").select(*f, "relation", "pid", "mode", kind.alias("kind")).distinct().join(
        a.withColumnsRenamed({"user_name": "blocked_user", "statement": "blocked_statement", "query_start": "blocked_start"}), [*f, "pid"], "left")
    j = (waiting.join(n, [*f, "relation", "kind"], "left").join(longest, [*f, "relation", "kind"], "left").join(own, [*f, "relation", "kind", "pid"], "left")
         .withColumn("by", F.when(F.col("first.pid") == F.col("pid"), F.col("second")).otherwise(F.col("first"))))
    return j.select(*f, "relation", F.col("pid").alias("blocked_pid"), F.col("mode").alias("blocked_mode"), "blocked_user", "blocked_statement",
                    _seconds_until(as_of, "blocked_start").alias("blocked_s"),
                    (F.coalesce("n_holders", F.lit(0)) - F.coalesce("self", F.lit(0))).alias("n_blocking"),
                    F.col("by.pid").alias("blocking_pid"), F.col("by.user_name").alias("blocking_user"), F.col("by.statement").alias("blocking_statement"),
                    _seconds_until(as_of, F.col("by.query_start")).alias("blocking_s"))


def lock_order(txns: DataFrame, tableinfo: DataFrame, *, relation=None, fleet: Sequence[str] = ()) -> DataFrame:
    """Transactions locking a relation by start time; of every relation when none is given."""
    names = tableinfo.select(*fleet, F.col("table_id").alias("relation"), "schema_name", "table_name")
    rows = only(txns, relation=relation).join(names, [*fleet, "relation"]).select(
        *fleet, "relation", "schema_name", "table_name", "txn_start", "xid", "pid", "txn_owner", "lock_mode", "granted")
    return rows if relation is None else rows.orderBy("txn_start", "xid")
