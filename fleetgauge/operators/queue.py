"""Queue waits, slot concurrency and workload-rule reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.alerts import alert_bit, alert_text
from ..functions.numeric import mean, percent, rounded, total_if
from ..functions.temporal import US, at, boundary_diff, ceil_to, day_of, epoch_us, floor_to, from_us, hour_of, int_div
from ..functions.temporal import unset_to_null
from ..functions.text import one_line, trimmed
from .ordered import exact_quantiles, exact_quantiles_few_groups, running_total
from .rows import cut, only, recent, since, told_of, top, user_rows

FIRST_USER_CLASS = 5
SECOND = US["second"]


def queue_wait_by_query(queuelog: DataFrame, querylog: DataFrame, *, as_of=None, lookback: float | None = None,
                        limit: int | None = None, text_chars: int | None = None, waited_only: bool = True,
                        fleet: Sequence[str] = ()) -> DataFrame:
    """Statements that waited in a queue, longest wait first.

    The window bounds the queueing; a statement that is not in ``querylog`` keeps its row without a text.
    """
    w = user_rows(recent(queuelog, "queue_start_time", as_of, lookback))
    if waited_only:
        w = w.where("total_queue_time > 0")
    q = querylog.select(*fleet, "query", "userid", "database", "querytxt")
    out = w.join(q, [*fleet, "query", "userid"], "left").select(
        *fleet,
        trimmed("database").alias("db"), "query", cut("querytxt", text_chars).alias("querytxt"), "queue_start_time",
        F.col("service_class").alias("class"), F.col("slot_count").alias("slots"),
        int_div("total_queue_time", SECOND).alias("queue_seconds"),
        int_div("total_exec_time", SECOND).alias("exec_seconds"),
        int_div(F.col("total_queue_time") + F.col("total_exec_time"), SECOND).alias("total_seconds"),
    )
    return top(out, limit, F.desc("queue_seconds"), F.desc("queue_start_time"), F.asc("query"))


def _queue_trend(queuelog: DataFrame, rules: DataFrame, bucket: Column, name: str, fleet: Sequence[str]) -> DataFrame:
    # aggregate per class first: the rule join then touches a handful of rows per bucket
    sums = queuelog.groupBy(*fleet, bucket.alias(name), "service_class").agg(
        F.count("query").alias("query_count"),
        F.sum("total_queue_time").alias("queue_us"), F.sum("total_exec_time").alias("exec_us"))
    cond = rules.select(*fleet, F.col("action_service_class").alias("service_class"), F.col("condition").alias("class_condition"))
    return sums.join(cond, [*fleet, "service_class"]).select(
        *fleet, name, "service_class", "class_condition", "query_count", "queue_us", "exec_us",
        percent("queue_us", "exec_us").alias("pct_queue"))


def queue_trend_daily(queuelog: DataFrame, rules: DataFrame, *, fleet: Sequence[str] = ()) -> DataFrame:
    """Queued and executed time per day, class and routing condition."""
    return _queue_trend(queuelog, rules, day_of("service_class_start_time"), "day", fleet)


def queue_trend_hourly(queuelog: DataFrame, rules: DataFrame, *, fleet: Sequence[str] = ()) -> DataFrame:
    """Queued and executed time per hour, class and routing condition."""
    return _queue_trend(queuelog, rules, hour_of("service_class_start_time"), "hour", fleet)


def queue_avg_max(queuelog: DataFrame, *, first_class: int = FIRST_USER_CLASS, fleet: Sequence[str] = ()) -> DataFrame:
    """Average and longest queue and execution time per class, in microseconds."""
    waited = boundary_diff("microsecond", "queue_start_time", "queue_end_time")
    ran = boundary_diff("microsecond", "exec_start_time", "exec_end_time")
    return queuelog.where(F.col("service_class") >= first_class).groupBy(*fleet, "service_class").agg(
        F.count("*").alias("n"), mean(waited).alias("avg_queue_us"), mean(ran).alias("avg_exec_us"),
        F.max(waited).alias("max_queue_us"), F.max(ran).alias("max_exec_us"))


def queue_detail(queuelog: DataFrame, *, query=None, xid=None) -> DataFrame:
    """Queue timeline of one statement or transaction; of all when none is given."""
    return only(queuelog, query=query, xid=xid).select(
        "userid", "xid", "query", "service_class", "slot_count", "queue_start_time", "exec_start_time", "exec_end_time",
        rounded(F.col("total_queue_time") / SECOND, 6).alias("queue_seconds"),
        rounded(F.col("total_exec_time") / SECOND, 6).alias("exec_seconds"),
        trimmed("final_state").alias("final_state"))


def _slot_changes(queuelog: DataFrame, first_class: int, step: int, low: int | None, high: int | None, fleet: Sequence[str]) -> DataFrame:
    """Net slot change per class and grid instant.

    A statement is active at the instants ``g`` with ``start <= g < end``, so on the grid it starts
    at the first instant not before its start and frees its slots at the first not before its end.
    """
    anchor = 0 if high is None else high % step
    first = ceil_to(epoch_us("service_class_start_time") - anchor, step) + anchor
    last = ceil_to(epoch_us("service_class_end_time") - anchor, step) + anchor
    if high is not None:
        first, last = F.greatest(first, F.lit(low)), F.least(last, F.lit(high))
        queuelog = queuelog.where((F.col("service_class_end_time") > _ntz(low - step)) & (F.col("service_class_start_time") <= _ntz(high)))
    spans = user_rows(queuelog).where(F.col("service_class") >= first_class).select(
        *fleet, "service_class", first.alias("first"), last.alias("last"), F.col("slot_count").cast("long").alias("slots")
    ).where("first < last")
    return spans.select(*fleet, "service_class", F.inline(F.array(
        F.struct(F.col("first").alias("pos"), F.col("slots").alias("delta")),
        F.struct(F.col("last").alias("pos"), (-F.col("slots")).alias("delta")))))


def _ntz(us: int) -> Column:
    """Microseconds since 1970 as a literal to compare the raw column with, so that the bound reaches the file scan."""
    return at(dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us))


def _levels(changes: DataFrame, fleet: Sequence[str]) -> DataFrame:
    """Slots in use from each change on (``level``), the net change summed per instant first."""
    net = changes.groupBy(*fleet, "service_class", "pos").agg(F.sum("delta").alias("delta"))
    return running_total(net, [*fleet, "service_class"], ["pos"], int_div(floor_to(F.col("pos"), US["hour"]), US["hour"]),
                         {"level": "delta"})


def _horizon(as_of, horizon_days: float) -> tuple[int, int]:
    end = dt.datetime.fromisoformat(str(as_of)).replace(tzinfo=dt.timezone.utc)
    high = int(end.timestamp()) * SECOND
    return high - int(horizon_days * US["day"]), high


def _configured(classcfg: DataFrame, first_class: int, fleet: Sequence[str]) -> DataFrame:
    return classcfg.where(F.col("service_class") >= first_class).select(*fleet, "service_class", "num_query_tasks")


def concurrency_peak(queuelog: DataFrame, classcfg: DataFrame, *, as_of, step_seconds: int = 5, horizon_days: float = 7,
                     first_class: int = FIRST_USER_CLASS, fleet: Sequence[str] = ()) -> DataFrame:
    """Most slots in use at any instant of a grid, with the last such instant and the last queueing.

    Statements are not expanded over the grid: the level only changes where one starts or ends, so
    two rows per statement, summed per instant, are enough.
    """
    step = step_seconds * SECOND
    low, high = _horizon(as_of, horizon_days)
    levels = _levels(_slot_changes(queuelog, first_class, step, low, high, fleet), fleet)
    # just before a change the previous level was in use, up to one step earlier
    held = F.struct((F.col("level") - F.col("delta")).alias("slots"), (F.col("pos") - step).alias("instant"))
    peak = levels.groupBy(*fleet, "service_class").agg(F.max(held).alias("peak"))
    queued = queuelog.where("total_queue_time > 0").groupBy(*fleet, "service_class").agg(
        F.max("queue_end_time").alias("last_queued_time"))
    return (peak.join(_configured(classcfg, first_class, fleet), [*fleet, "service_class"]).join(queued, [*fleet, "service_class"], "left")
            .select(*fleet, "service_class", F.col("num_query_tasks").alias("configured_slots"), F.col("peak.slots").alias("max_slots"),
                    from_us("peak.instant").alias("max_slots_ts"), "last_queued_time"))


def concurrency_peak_hourly(queuelog: DataFrame, classcfg: DataFrame, *, as_of, step_seconds: int = 1,
                            horizon_days: float = 7, first_class: int = FIRST_USER_CLASS,
                            fleet: Sequence[str] = ()) -> DataFrame:
    """Most slots in use per class and hour, at the instants of a grid."""
    step = step_seconds * SECOND
    low, high = _horizon(as_of, horizon_days)
    changes = _slot_changes(queuelog, first_class, step, low, high, fleet)
    cfg = _configured(classcfg, first_class, fleet)
    # a change of zero at each hour's first instant carries the level of long statements into it
    hours = F.explode(F.sequence(F.lit(low - low % US["hour"]), F.lit(high), F.lit(US["hour"]))).alias("hour_us")
    marks = cfg.select(*fleet, "service_class", hours).select(
        *fleet, "service_class", (ceil_to(F.col("hour_us") - high % step, step) + high % step).alias("pos"),
        F.lit(0).cast("long").alias("delta"))
    hourly = _levels(changes.unionByName(marks), fleet).groupBy(*fleet, "service_class", hour_of(from_us("pos")).alias("hour")).agg(
        F.max("level").alias("max_slots")).where("max_slots > 0")
    h = F.hour("hour").cast("string")
    return hourly.join(cfg, [*fleet, "service_class"]).select(
        *fleet, "service_class", F.col("num_query_tasks").alias("configured_slots"), day_of("hour").alias("day"),
        F.concat(h, F.lit(":00 - "), h, F.lit(":59")).alias("hour"), "max_slots")


def concurrency_at(queuelog: DataFrame, classcfg: DataFrame, *, as_of, step_seconds: int = 3600, horizon_days: float = 7,
                   first_class: int = FIRST_USER_CLASS, fleet: Sequence[str] = ()) -> DataFrame:
    """Slots in use at each instant of a grid: an instant-in-interval join without expanding intervals."""
    step = step_seconds * SECOND
    low, high = _horizon(as_of, horizon_days)
    grid = F.explode(F.sequence(F.lit(low), F.lit(high - step), F.lit(step))).alias("pos")
    marks = _configured(classcfg, first_class, fleet).select(*fleet, "service_class", grid).withColumn("delta", F.lit(0).cast("long"))
    levels = _levels(_slot_changes(queuelog, first_class, step, low, high, fleet).unionByName(marks), fleet)
    return levels.where((F.col("pos") < high) & (F.col("level") > 0)).select(*fleet, "service_class", from_us("pos").alias("instant"), F.col("level").alias("slots"))


def concurrency_exact(queuelog: DataFrame, *, first_class: int = FIRST_USER_CLASS, fleet: Sequence[str] = ()) -> DataFrame:
    """The true maximum of slots in use, at microsecond resolution, and when it was first reached."""
    levels = _levels(_slot_changes(queuelog, first_class, 1, None, None, fleet), fleet)
    reached = F.struct(F.col("level").alias("slots"), (-F.col("pos")).alias("neg"))
    peak = levels.groupBy(*fleet, "service_class").agg(F.max(reached).alias("peak"))
    return peak.select(*fleet, "service_class", F.col("peak.slots").alias("max_slots"), from_us(-F.col("peak.neg")).alias("max_slots_ts"))


def join_where(left: DataFrame, right: DataFrame, keys: Sequence[str], also: Column) -> DataFrame:
    """Left join on ``keys`` and a further condition on the other columns, which have different names.

    With the further condition apart, the join needs its rows dealt by ``keys`` only.
    """
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys], also)
    return left.join(right, on, "left")


def queue_resources_hourly(queuelog: DataFrame, metrics: DataFrame, cachelog: DataFrame, *, as_of=None,
                           lookback: float | None = None, first_class: int = FIRST_USER_CLASS + 1, fleet: Sequence[str] = ()) -> DataFrame:
    """Outcomes and resources per hour and class; result-cache hits are reported as class 0.

    The metrics of a statement carry no time of their own, so they are met by statement: stored in buckets of
    (fleet, query), log and metrics join without a shuffle.
    """
    by_statement = [*fleet, "query"]
    w = recent(queuelog, "exec_start_time", as_of, lookback).where(F.col("service_class") >= first_class)
    state = trimmed("final_state")
    met = metrics.withColumnsRenamed({"userid": "__user", "service_class": "__class"})
    same = (F.col("userid") == F.col("__user")) & (F.col("service_class") == F.col("__class"))
    ran = join_where(w, met, by_statement, same).groupBy(
        *fleet, hour_of("exec_start_time").alias("exec_hour"), F.col("service_class").cast("int").alias("class")).agg(
        total_if(state == "Completed").alias("n_completed"), total_if(state == "Evicted").alias("n_evicted"),
        mean(int_div("total_queue_time", SECOND)).alias("avg_queue_s"),
        mean(int_div("total_exec_time", SECOND)).alias("avg_exec_s"),
        mean("query_cpu_usage_percent").alias("avg_pct_cpu"), F.max("query_cpu_usage_percent").alias("max_pct_cpu"),
        F.max("query_temp_blocks_to_disk").alias("max_spill_mb"), F.sum("query_temp_blocks_to_disk").alias("sum_spill_mb"),
        F.sum("scan_row_count").alias("scan_rows"), F.sum("join_row_count").alias("join_rows"),
        F.sum("nested_loop_join_row_count").alias("nl_join_rows"), F.sum("return_row_count").alias("return_rows"),
        F.sum("spectrum_scan_size_mb").alias("external_mb"))
    c = recent(cachelog, "starttime", as_of, lookback).where(F.col("source_query").isNotNull())
    m = metrics.select(*fleet, "userid", F.col("query").alias("source_query"), "return_row_count")
    zero = F.lit(0).cast("long")
    # one dashboard statement can own most hits: they are counted per statement before the join
    counted = c.groupBy(*fleet, hour_of("starttime").alias("exec_hour"), "userid", "source_query").agg(
        F.count("*").alias("n"), total_if(F.col("aborted") == 0).alias("completed"), total_if(F.col("aborted") == 1).alias("evicted"),
        F.sum(int_div("elapsed", SECOND)).alias("ran"), F.count("elapsed").alias("n_ran"))
    hits = counted.join(m, [*fleet, "userid", "source_query"], "left").groupBy(*fleet, "exec_hour").agg(
        F.sum("completed").alias("n_completed"), F.sum("evicted").alias("n_evicted"),
        rounded(F.try_divide(F.sum("ran").cast("double"), F.sum("n_ran")), 4).alias("avg_exec_s"),
        F.sum(F.col("return_row_count") * F.col("n")).alias("return_rows"),
    ).select(*fleet, "exec_hour", F.lit(0).alias("class"), "n_completed", "n_evicted", F.lit(0.0).alias("avg_queue_s"),
             "avg_exec_s", F.lit(0.0).alias("avg_pct_cpu"), *[zero.alias(x) for x in (
                 "max_pct_cpu", "max_spill_mb", "sum_spill_mb", "scan_rows", "join_rows", "nl_join_rows")],
             "return_rows", zero.alias("external_mb"))
    return ran.unionByName(hits)


# The metrics that a monitoring rule can test.
RULE_METRICS = (
    "query_cpu_time", "query_blocks_read", "query_execution_time", "query_cpu_usage_percent",
    "query_temp_blocks_to_disk", "segment_execution_time", "cpu_skew", "io_skew", "scan_row_count",
    "join_row_count", "nested_loop_join_row_count", "return_row_count", "spectrum_scan_row_count",
    "spectrum_scan_size_mb",
)


def rule_candidates(metrics: DataFrame, *, columns=RULE_METRICS, fleet: Sequence[str] = ()) -> DataFrame:
    """Thresholds worth a monitoring rule: a rounded-up 99th percentile far below the maximum.

    All metrics are unpivoted at once; two passes over the log replace one sort per metric.
    """
    per = [*fleet, "service_class"]
    long = user_rows(metrics).unpivot(per, list(columns), "metric", "value")
    # classes and metrics of one cluster are a fixed, small set of groups; those of a fleet are not
    stats = (exact_quantiles if fleet else exact_quantiles_few_groups)(long, [*per, "metric"], "value", {"p50": 0.5, "p99": 0.99, "pmax": 1.0})
    digits = F.floor(F.col("p99") / 10).cast("string")
    lead = F.substring(F.floor(F.col("p99")).cast("string"), 1, 1).cast("int")
    ranked = W.partitionBy(*per).orderBy(F.desc("share"), F.asc("metric"))
    return (stats.where("p99 >= 10 and p50 + p99 < pmax")
            .withColumn("candidate", (lead + 1) * F.pow(F.lit(10.0), F.length(digits)))
            .where("candidate < pmax").withColumn("share", F.col("pmax") / F.col("candidate"))
            .select(*per, "metric", rounded("p50", 4).alias("p50"), rounded("p99", 4).alias("p99"),
                    "pmax", "candidate", rounded("share", 2).alias("magnitude"),
                    F.row_number().over(ranked).alias("rule_order")))


def queue_state(classcfg: DataFrame, class_state: DataFrame, rules: DataFrame, *,
                first_class: int = FIRST_USER_CLASS, fleet: Sequence[str] = ()) -> DataFrame:
    """Configuration, routing condition and live counters of each queue."""
    at_class = [*fleet, "service_class"]
    r = rules.select(*fleet, F.col("action_service_class").alias("service_class"), trimmed("condition").alias("description"))
    return (classcfg.where(F.col("service_class") >= first_class).join(class_state, at_class).join(r, at_class)
            .select(*fleet, (F.col("service_class") - FIRST_USER_CLASS).alias("queue"), "description",
                    F.col("num_query_tasks").alias("slots"), F.col("query_working_mem").alias("mem"),
                    F.col("max_execution_time").alias("max_time"), "user_group_wild_card", "query_group_wild_card",
                    F.col("num_queued_queries").alias("queued"), F.col("num_executing_queries").alias("executing"),
                    F.col("num_executed_queries").alias("executed")))


def queue_commit_breakdown(querylog: DataFrame, commitlog: DataFrame, queuelog: DataFrame, *, as_of=None, lookback: float | None = None,
                           first_class: int = FIRST_USER_CLASS, fleet: Sequence[str] = ()) -> DataFrame:
    """Share of time spent queued, executing, waiting to commit and committing, per day, class, node.

    The window bounds the statements' start; queue and commit rows are read from its first instant on. A transaction's
    commits are summed per node before they meet its statements; every statement counts with every commit. Sums are
    exact decimals: spans of many years outgrow 64 bits after some ten thousand commits.
    """
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    us = lambda a, b: boundary_diff("microsecond", a, b)
    q = recent(querylog, "starttime", as_of, lookback).select(
        *fleet, "query", "xid", day_of("starttime").alias("day"), us("starttime", "endtime").alias("exec"))
    waited = F.coalesce(unset_to_null("startqueue"), F.col("startwork"))
    c = since(commitlog, "endtime", as_of, lookback).where("xid > 0").groupBy(*fleet, "xid", "node").agg(
        F.count("*").alias("n"), F.count("endtime").alias("n_ends"), F.sum(epoch_us("endtime").cast("decimal(19,0)")).alias("ends"),
        F.sum(us(waited, "startwork").cast("decimal(19,0)")).alias("commit_queue"), F.sum(us("startwork", "endtime").cast("decimal(19,0)")).alias("commit"))
    w = since(queuelog, "service_class_end_time", as_of, lookback).where(F.col("service_class") >= first_class).select(
        *fleet, "query", "service_class", epoch_us("service_class_start_time").alias("begin"), us("queue_start_time", "queue_end_time").alias("queue"))
    sums = q.join(w, [*fleet, "query"]).join(c, [*fleet, "xid"]).groupBy(*fleet, "day", "service_class", "node").agg(
        F.count_distinct("xid").alias("n_commits"), F.sum(F.col("ends") - whole("n_ends") * whole("begin")).alias("total_us"),
        F.sum(whole("queue") * whole("n")).alias("queue_us"), F.sum(whole("exec") * whole("n")).alias("exec_us"),
        F.sum("commit_queue").alias("commit_queue_us"), F.sum("commit").alias("commit_us"))
    return sums.select("*", *[percent(f"{x}_us", "total_us").alias(f"pct_{x}") for x in
                              ("queue", "exec", "commit_queue", "commit")])


def cursor_text(utilitytext: DataFrame, fleet: Sequence[str] = ()) -> DataFrame:
    """The SELECT behind each transaction's cursor declaration, one per transaction."""
    start = F.instr(F.upper("text"), "SELECT")
    body = F.expr("substring(text, instr(upper(text), 'SELECT'))")
    return (utilitytext.where((F.col("sequence") == 0) & F.upper("text").like("DECLARE%") & (start > 0))
            .groupBy(*fleet, "xid").agg(F.max(F.concat(F.lit("CURSOR "), F.trim(body))).alias("cursor_text")))


def alert_mask(alertlog: DataFrame, *, as_of=None, lookback: float | None = None, fleet: Sequence[str] = ()) -> DataFrame:
    """Bits of the alert kinds raised by each statement; a repeated kind sets its bit once."""
    return recent(alertlog, "event_time", as_of, lookback).groupBy(*fleet, "query").agg(
        F.bit_or(alert_bit("event")).alias("mask"))


def running_queries(queue_state: DataFrame, statements: DataFrame, stepmetrics: DataFrame, users: DataFrame,
                    utilitytext: DataFrame, alertlog: DataFrame, *, as_of=None, lookback: float | None = None,
                    text_chars: int | None = None, fleet: Sequence[str] = ()) -> DataFrame:
    """Statements now in a queue with their resources so far, text and alerts.

    The snapshot holds a handful of statements; every log is cut down to them before anything is summed.
    """
    by_query, by_xid = [*fleet, "query"], [*fleet, "xid"]
    live = lambda log, keys=by_query: told_of(log, queue_state, keys)
    # one pass over the step metrics: totals row, returned rows and nested-loop rows per statement
    m = live(stepmetrics).groupBy(*by_query).agg(
        F.max(F.when((F.col("segment") == -1) & (F.col("step") == -1), F.struct("cpu_time", "blocks_read", "blocks_to_disk"))).alias("t"),
        F.sum(F.when(F.col("step_type") == 38, F.col("rows"))).alias("ret_rows"),
        F.sum(F.when(F.col("step_type") == 15, F.col("rows"))).alias("nl_rows"))
    s = live(statements).select(*by_query, "pid", F.col("userid").alias("usesysid"), F.col("querytxt").alias("text"))
    u = users.select(*fleet, "usesysid", trimmed("usename").alias("user"))
    state = trimmed("state")
    short = F.when(state == "Running", "Run").when(state == "QueuedWaiting", "Queue").when(state == "Returning", "Return").otherwise(state)
    sql = F.replace(F.coalesce("cursor_text", one_line("text")), F.lit("\\n"), F.lit(" "))
    return (queue_state.join(s, by_query, "left").join(m, by_query, "left").join(u, [*fleet, "usesysid"], "left")
            .join(cursor_text(live(utilitytext, by_xid), fleet), by_xid, "left")
            .join(alert_mask(live(alertlog), as_of=as_of, lookback=lookback, fleet=fleet), by_query, "left")
            .select(*fleet, "user", "pid", "xid", "query", F.col("service_class").alias("class"), F.col("slot_count").alias("slots"),
                    F.date_trunc("second", "wlm_start_time").cast("timestamp_ntz").alias("start"), short.alias("state"),
                    int_div("queue_time", SECOND).alias("queue_s"), int_div("exec_time", SECOND).alias("exec_s"),
                    int_div("t.cpu_time", SECOND).alias("cpu_s"), F.col("t.blocks_read").alias("read_mb"),
                    F.nullif(F.col("t.blocks_to_disk"), F.lit(-1)).alias("spill_mb"), "ret_rows", "nl_rows",
                    cut(sql, text_chars).alias("sql"), alert_text("mask").alias("alert")))


def active_sessions(sessions: DataFrame, recents: DataFrame, *, as_of, fleet: Sequence[str] = ()) -> DataFrame:
    """Open sessions with the statement each one is running, if any."""
    # the status test belongs to the join: idle sessions must stay
    r = recents.where(F.trim("status") == "Running").select(
        *fleet, F.col("pid").alias("process"), F.col("starttime").alias("query_start"), F.trim("query").alias("query_text"))
    return sessions.join(r, [*fleet, "process"], "left").select(
        *fleet, F.col("process").alias("pid"), "starttime", boundary_diff("minute", "starttime", at(as_of)).alias("connected_minutes"),
        trimmed("user_name").alias("user_name"), trimmed("db_name").alias("db_name"), "query_start", "query_text")


def timed_out_returning(queue_state: DataFrame, classcfg: DataFrame, *, fleet: Sequence[str] = ()) -> DataFrame:
    """Statements past their class's time limit that are still returning rows."""
    cfg = classcfg.where("max_execution_time > 0").select(*fleet, "service_class", "max_execution_time")
    return queue_state.where(F.trim("state") == "Returning").join(cfg, [*fleet, "service_class"]).where(
        int_div("exec_time", SECOND) > F.col("max_execution_time")).select(
        *fleet, "query", "xid", "service_class", "slot_count", "wlm_start_time", "exec_time", "max_execution_time")


def live_steps(stepstate: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Running steps with elapsed time, rows in units of 10,000 and megabytes, heaviest first."""
    out = stepstate.select(
        boundary_diff("microsecond", "starttime", "currenttime").alias("elapsed_us"),
        boundary_diff("minute", "starttime", "currenttime").alias("elapsed_min"),
        "query", "slice", "segment", "step", "tasknum", "label", rounded(F.col("rows") / 10000.0, 4).alias("rows_10k"),
        rounded(F.col("bytes") / 1048576.0, 4).alias("mbytes"), "num_parts")
    return top(out, limit, F.desc("mbytes"), F.desc("rows_10k"), "query", "slice", "segment", "step", "tasknum", "elapsed_us")
