"""Statement, step, alert and network reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.alerts import alert_kind, alert_label, alert_text
from ..functions.numeric import mean, percent, ratio, rounded
from ..functions.temporal import US, at, boundary_diff, day_of, hour_of, int_div, unset_to_null
from ..functions.text import leading_word, statement_class, trimmed
from .ordered import band_mean, covered, magnitude_bucket, running_total
from .queue import alert_mask, cursor_text, join_where, queue_wait_by_query
from .rows import between, catalog_keys, cut, only, recent, since, told_of, top, user_rows
from .transactions import commit_rows

SECOND = US["second"]
WORKTABLE = "Internal Worktable"


def _run_seconds() -> Column:
    return boundary_diff("second", "starttime", "endtime").cast("double")


def _with_text(sums: DataFrame, statements: DataFrame, limit: int | None, fleet: Sequence[str]) -> DataFrame:
    """The groups (the heaviest ones, with a limit) with the text of their sample statement.

    Texts are joined last: no aggregate and no sort carries them. Of a statement that is logged twice, the row with the
    group's text is taken; the texts of other statements are not moved.
    """
    best = (F.desc("total_s"), F.asc("last_query"))
    key = [*fleet, "last_query", "fingerprint"]
    out = top(sums, limit, *best)
    texts = statements.select(*fleet, F.col("query").alias("last_query"), F.md5("__text").alias("fingerprint"), F.col("__text").alias("querytxt"))
    texts = told_of(texts, out, key).groupBy(*key).agg(F.max("querytxt").alias("querytxt"))
    out = out.join(texts, key)
    return out if limit is None else out.orderBy(*best)


def top_queries(querylog: DataFrame, alertlog: DataFrame, *, as_of=None, lookback: float | None = None,
                limit: int | None = None, fan_out: bool = False, by_event: bool = False, fleet: Sequence[str] = ()) -> DataFrame:
    """Heaviest statements by database, label, text fingerprint and outcome, with their alerts.

    ``fan_out=True`` counts a statement once per alert kind it raised, as joining the alerts does;
    ``by_event=True`` also reports each kind in a row of its own (``event``; null for statements without alerts).
    """
    by_query = [*fleet, "query"]
    kind = recent(alertlog, "event_time", as_of, lookback).select(*by_query, alert_label(alert_kind("event")).alias("event")).distinct()
    q = user_rows(recent(querylog, "starttime", as_of, lookback)).withColumn("secs", _run_seconds()).withColumn("__text", trimmed("querytxt"))
    facts = q.select(*by_query, trimmed("database").alias("db"), "label", F.md5("__text").alias("fingerprint"), "aborted", "secs", "starttime")
    keys = [*fleet, "db", "label", "fingerprint", "aborted"]
    if by_event:
        facts, weight, extra = facts.join(kind, by_query, "left"), F.lit(1), []
        keys = [*keys, "event"]
    else:
        kinds = kind.groupBy(*by_query).agg(F.collect_set("event").alias("kinds"))
        facts = facts.join(kinds, by_query, "left")
        weight = F.greatest(F.coalesce(F.size("kinds"), F.lit(1)), F.lit(1)) if fan_out else F.lit(1)
        # distinct kind lists per group are few, so the set stays small however many statements it has
        extra = [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))), ", ").alias("events")]
    sums = facts.withColumn("w", weight).groupBy(*keys).agg(
        F.sum("w").cast("long").alias("n"), F.min("secs").alias("min_s"), F.max("secs").alias("max_s"),
        rounded(F.sum(F.col("secs") * F.col("w")) / F.sum("w"), 4).alias("avg_s"),
        F.sum(F.col("secs") * F.col("w")).alias("total_s"), F.max("query").alias("last_query"),
        day_of(F.max("starttime")).alias("last_run"), *extra)
    return _with_text(sums, q, limit, fleet)


def top_queries_resources(querylog: DataFrame, metrics: DataFrame, alertlog: DataFrame, utilitytext: DataFrame, *,
                          as_of=None, lookback: float | None = None, limit: int | None = None, fleet: Sequence[str] = ()) -> DataFrame:
    """Heaviest statements by user and text with resources; cursor statements show their SELECT.

    Metrics and utility texts are met by statement and transaction; of both, only what belongs to the window goes on.
    """
    by_query, by_xid = [*fleet, "query"], [*fleet, "xid"]
    log = user_rows(recent(querylog, "starttime", as_of, lookback))
    m = metrics.select(*by_query, F.col("userid").alias("__user"), "service_class", "query_cpu_time", "query_cpu_usage_percent",
                       "query_temp_blocks_to_disk", "query_blocks_read", "return_row_count")
    cursors = cursor_text(told_of(utilitytext, log, by_xid), fleet)
    text = F.coalesce("cursor_text", trimmed("querytxt"))
    # all that is met by statement comes first: logs stored by statement join without a shuffle
    met = join_where(log, m, by_query, F.col("userid") == F.col("__user")).join(
        alert_mask(alertlog, as_of=as_of, lookback=lookback, fleet=fleet), by_query, "left")
    out = (met.join(cursors, by_xid, "left").withColumns({"db": trimmed("database"), "fingerprint": F.md5(text), "secs": _run_seconds()})
           .groupBy(*fleet, "db", "userid", "fingerprint", "aborted", "mask").agg(
               F.count("query").alias("n"), F.max("secs").alias("max_s"), mean("secs").alias("avg_s"),
               F.sum("secs").alias("total_s"), F.max("service_class").alias("class"), mean("query_cpu_time").alias("avg_cpu"),
               mean("query_cpu_usage_percent").alias("avg_cpu_pct"), mean("query_temp_blocks_to_disk").alias("avg_spill"),
               mean("query_blocks_read").alias("avg_mb_read"), mean("return_row_count").alias("avg_rows_ret"),
               F.max("query").alias("last_query"), day_of(F.max("starttime")).alias("last_run"))
           .withColumn("alert", alert_text("mask")).drop("mask"))
    return _with_text(out, log.join(cursors, by_xid, "left").withColumn("__text", text), limit, fleet)


def query_type_summary(querylog: DataFrame) -> DataFrame:
    """Durations by database, statement class and hour of day: mean, middle half, middle and top 5 %.

    Statements are ranked within database and class. Equal (duration, hour) pairs are counted
    before ranking, and a band mean takes each pair's overlap with the band, so no group is sorted
    row by row.
    """
    cells = querylog.withColumn("lowered", F.lower("querytxt")).select(
        F.coalesce(trimmed("database"), F.lit("")).alias("database"), statement_class("querytxt", "userid", "lowered").alias("query_type"),
        F.hour("starttime").alias("query_hour"), boundary_diff("millisecond", "starttime", "endtime").alias("ms"),
    ).where("ms is not null and query_hour is not null").groupBy("database", "query_type", "ms", "query_hour").agg(F.count("*").alias("n"))
    rank = ["database", "query_type"]
    ranked = running_total(cells, rank, ["ms", "query_hour"], magnitude_bucket(F.col("ms")), {"upto": "n"}, {"total": "n"})
    cell = (F.col("ms"), F.col("n"), F.col("upto"), F.col("total"))
    return ranked.groupBy(*rank, "query_hour").agg(
        F.sum("n").alias("n"), rounded(F.sum(F.col("ms") * F.col("n")) / F.sum("n"), 4).alias("avg_ms"),
        rounded(band_mean(*cell, 6, 15, 20), 4).alias("central_ms"), rounded(band_mean(*cell, 10, 11, 20), 4).alias("p50_ms"),
        rounded(band_mean(*cell, 20, 20, 20), 4).alias("p95_ms"))


_STEP = ["query", "slice", "segment"]


def _step_work(log: DataFrame, prefix: str, fleet: Sequence[str], *extra: str) -> DataFrame:
    """Seconds (never negative), rows and row count per step location, summed before any join."""
    secs = F.greatest(boundary_diff("second", "starttime", "endtime"), F.lit(0))
    return log.groupBy(*fleet, *_STEP, *extra).agg(F.sum(secs).alias(f"{prefix}_secs"), F.sum("rows").alias(f"{prefix}_rows"),
                                           F.count("*").alias(f"{prefix}_n"))


def _alert_work(alertlog: DataFrame, scanlog: DataFrame, distlog: DataFrame, bcastlog: DataFrame, fan_out: bool,
                as_of, lookback, fleet: Sequence[str]) -> DataFrame:
    alerts = user_rows(recent(alertlog, "event_time", as_of, lookback)).groupBy(
        *fleet, *_STEP, alert_kind("event").alias("event"), trimmed("solution").alias("solution")).agg(F.count("*").alias("n_events"))
    at = [*fleet, *_STEP]
    # an alert names the step's place; the work logs are cut down to those places before they are summed
    told = lambda log: log.join(alerts.select(*at), at, "left_semi")
    j = (alerts.join(_step_work(told(scanlog), "s", fleet, "tbl", "perm_table_name"), at)
         .join(_step_work(told(distlog), "d", fleet), at, "left").join(_step_work(told(bcastlog), "b", fleet), at, "left"))
    if fan_out:
        # what joining the raw rows would add up to: every match repeats for each row of the others
        scans, dists, casts = F.col("s_n"), F.coalesce("d_n", F.lit(1)), F.coalesce("b_n", F.lit(1))
        def pick(x):
            return F.col("n_events") * F.coalesce(F.col(f"b_{x}") * scans * dists, F.col(f"d_{x}") * scans, F.col(f"s_{x}"))
        return j.select(*j.columns, pick("secs").alias("secs"), pick("rows").alias("rows"),
                        (F.col("n_events") * scans * dists * casts).alias("hits"))
    return j.select(*j.columns, F.coalesce("b_secs", "d_secs", "s_secs").alias("secs"),
                    F.coalesce("b_rows", "d_rows", "s_rows").alias("rows"), F.col("n_events").alias("hits"))


def alerts_by_table(alertlog: DataFrame, scanlog: DataFrame, distlog: DataFrame, bcastlog: DataFrame, tableinfo: DataFrame, *,
                    texts: DataFrame | None = None, as_of=None, lookback: float | None = None, fan_out: bool = False,
                    solution_chars: int | None = None, fleet: Sequence[str] = ()) -> DataFrame:
    """Alerts with the time and rows of the steps they point at, per table and solution.

    A broadcast's figures win over a distribution's, and those over the scan's. ``texts`` (query,
    text) splits the report by statement text.
    """
    work = _alert_work(alertlog, scanlog, distlog, bcastlog, fan_out, as_of, lookback, fleet)
    t = tableinfo.select(*fleet, F.col("table_id").alias("tbl"), F.col("schema_name").alias("schema"))
    work = work.where(~F.col("perm_table_name").like("volt_tt%")).join(t, [*fleet, "tbl"]).where("schema is not null")
    keys = [*fleet, F.col("schema"), trimmed("perm_table_name").alias("table"), F.col("event"), cut("solution", solution_chars).alias("solution")]
    aggs = [rounded(F.sum("secs") / 60.0, 4).alias("minutes"), F.sum("rows").alias("rows"), F.max("query").alias("sample_query"),
            F.count_distinct("query").alias("n_queries"), F.sum("hits").alias("n_events")]
    if texts is None:
        return work.groupBy(*keys).agg(*aggs)
    # the texts themselves are joined last, one for each row of the report
    work = work.join(texts.select(*fleet, "query", F.md5("text").alias("fingerprint")), [*fleet, "query"], "left")
    named = [F.col(c) if isinstance(c, str) else c for c in keys]
    out = work.groupBy(*named, "fingerprint").agg(*aggs)
    said = texts.select(*fleet, F.col("query").alias("sample_query"), F.col("text").alias("query_text"))
    return out.join(told_of(said, out, [*fleet, "sample_query"]), [*fleet, "sample_query"], "left").drop("fingerprint")


def table_alerts(alertlog: DataFrame, scanlog: DataFrame, distlog: DataFrame, bcastlog: DataFrame, tableperm: DataFrame,
                 classes: DataFrame, ns: DataFrame, *, as_of=None, lookback: float | None = None, fan_out: bool = False,
                 fleet: Sequence[str] = ()) -> DataFrame:
    """Alerts per table next to the table's row count, without statement texts."""
    work = _alert_work(alertlog, scanlog, distlog, bcastlog, fan_out, as_of, lookback, fleet).where(
        ~F.col("perm_table_name").like("volt_tt%") & (F.trim("perm_table_name") != WORKTABLE))
    per_table = work.groupBy(*fleet, "tbl", trimmed("perm_table_name").alias("table"), "event", "solution").agg(
        F.sum("secs").alias("secs"), F.sum("rows").alias("scanned_rows"), F.max("query").alias("sample_query"), F.sum("hits").alias("n_events"))
    rows = tableperm.groupBy(*fleet, F.col("id").alias("tbl")).agg(F.sum("rows").alias("table_rows"))
    keys = catalog_keys(fleet, classes, ns)
    names = classes.join(ns.select(*keys, F.col("oid").alias("relnamespace"), trimmed("nspname").alias("schema")),
                         [*keys, "relnamespace"]).select(*fleet, F.col("oid").alias("tbl"), "schema")
    return per_table.join(rows, [*fleet, "tbl"], "left").join(names, [*fleet, "tbl"], "left").groupBy(
        *fleet, "schema", "table", "table_rows", "event", "solution").agg(
        rounded(F.sum("secs") / 60.0, 4).alias("minutes"), F.sum("scanned_rows").alias("scanned_rows"),
        F.max("sample_query").alias("sample_query"), F.sum("n_events").alias("n_events"))


def alert_list(alertlog: DataFrame, *, query=None, chars: int | None = None, fleet: Sequence[str] = ()) -> DataFrame:
    """Alert events and proposed solutions of statements."""
    return only(alertlog, query=query).select(*fleet, "query", cut(trimmed("event"), chars).alias("event"),
                                              cut(trimmed("solution"), chars).alias("solution"), "event_time")


def alert_bits(alertlog: DataFrame, *, fleet: Sequence[str] = ()) -> DataFrame:
    """The alert kinds of each statement as a bit mask and as text."""
    return alert_mask(alertlog, fleet=fleet).withColumn("alert", alert_text("mask"))


def missing_stats(planlog: DataFrame, *, ignore_like: str = "%auto\\_health\\_check\\_%") -> DataFrame:
    """Plan nodes that lacked table statistics, and how often; the server's own checks are ignored."""
    node = trimmed("plannode")
    return planlog.where(F.col("plannode").like("%missing statistics%") & ~F.col("plannode").like(ignore_like)).groupBy(
        node.alias("plannode")).agg(F.count("*").alias("n"))


def filters_used(planlog: DataFrame, planinfo: DataFrame, scanlog: DataFrame, *, as_of=None, lookback: float | None = None,
                 table_like: str = "%", fleet: Sequence[str] = ()) -> DataFrame:
    """Filter texts applied to each table with scan seconds, statements and a sample statement.

    Plans carry no time: both plan logs are cut down to the statements of the window's scans before they meet.
    """
    by_query = [*fleet, "query"]
    step, node = [*by_query, "userid", "segment", "step"], [*by_query, "userid", "nodeid"]
    scans = recent(scanlog, "starttime", as_of, lookback).where(
        ~F.col("perm_table_name").like(f"{WORKTABLE}%") & F.col("perm_table_name").like(table_like))
    s = scans.groupBy(*step, trimmed("perm_table_name").alias("table")).agg(
        F.sum(F.greatest(boundary_diff("second", "starttime", "endtime"), F.lit(0))).alias("secs"))
    p = planlog.where((F.col("info").like("Filter:%") & (F.col("nodeid") > 0)) | F.col("info").like("Join Filter:%")).select(
        *node, trimmed("info").alias("filter"))
    i = told_of(planinfo.select(*node, "segment", "step"), scans, by_query)
    return told_of(p, scans, by_query).join(i, node).join(s, step).groupBy(*fleet, "table", "filter").agg(
        F.sum("secs").alias("secs"), F.count_distinct("query").alias("n_queries"), F.max("query").alias("last_query"))


NO_USE = "2000-01-01"
PREDICATE_KIND = 10002


def predicate_columns(colstats: DataFrame, classes: DataFrame, ns: DataFrame, attrs: DataFrame, *,
                      fleet=("cluster_id",)) -> DataFrame:
    """Columns used as predicates: first use, last analyze and column statistics.

    The two timestamps sit packed as ``a||b`` in whichever of four statistic slots has the kind.
    """
    fleet = list(fleet)
    packed = F.coalesce(*[F.when(F.col(f"stakind{k}") == PREDICATE_KIND, F.col(f"stavalues{k}")) for k in (1, 2, 3, 4)])
    st = colstats.select(*fleet, F.col("starelid").alias("oid"), F.col("staattnum").alias("col_num"),
                         F.col("stanullfrac").alias("pct_null"), F.col("stawidth").alias("avg_width"),
                         F.when(F.col("stadistinct") >= 0, F.col("stadistinct")).alias("n_distinct"), packed.alias("packed"))
    a = attrs.select(*fleet, F.col("attrelid").alias("oid"), F.col("attnum").alias("col_num"), F.col("attname").alias("col_name"),
                     F.col("attisdistkey").alias("is_distkey"), F.col("attsortkeyord").alias("sortkey_ord"))
    c = classes.select(*fleet, "oid", F.col("relname").alias("table_name"), "relnamespace")
    n = ns.select(*fleet, F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema_name"))
    used = ~F.col("packed").like(f"{NO_USE}%")
    part = lambda k: F.split_part("packed", F.lit("||"), F.lit(k)).try_cast("timestamp_ntz")
    return (st.where(used).join(a, [*fleet, "oid", "col_num"]).join(c, [*fleet, "oid"]).join(n, [*fleet, "relnamespace"])
            .select(*fleet, "schema_name", "table_name", "col_num", "col_name", F.lit(True).alias("is_predicate"), part(1).alias("first_predicate_use"),
                    F.when(~F.col("packed").like(f"%||{NO_USE}%"), part(2)).alias("last_analyze"),
                    "pct_null", "avg_width", "n_distinct", "is_distkey", "sortkey_ord"))


def query_steps(steplog: DataFrame, *, query=None, fleet: Sequence[str] = ()) -> DataFrame:
    """Work of each step summed over slices: time span, rows, filtering and memory."""
    return only(steplog, query=query).groupBy(
        *fleet, "query", "segment", "step", "label", "is_rrscan", "is_diskbased", "is_delayed_scan").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        boundary_diff("millisecond", F.min("start_time"), F.max("end_time")).alias("elapsed_ms"), F.sum("rows").alias("rows"),
        F.sum("rows_pre_filter").alias("rows_pre_filter"),
        F.coalesce(percent(F.sum("rows"), F.sum("rows_pre_filter")), F.lit(100.0)).alias("pct_filter"),
        int_div(F.sum("workmem"), 1048576).alias("memory_mb"), int_div(F.sum("bytes"), 1048576).alias("produced_mb"))


def query_summary(stepsummary: DataFrame, *, query=None, fleet: Sequence[str] = ()) -> DataFrame:
    """Step tree of a statement: the label is indented by stream, segment and step."""
    label = F.concat(F.repeat(F.lit(" "), F.col("stm") + F.col("seg") + F.col("step")), F.col("label"))
    return only(stepsummary, query=query).select(
        *fleet, "query", "stm", "seg", "step", "maxtime", "avgtime", "rows", "bytes", label.alias("label"), "is_diskbased", "workmem",
        "is_rrscan", "is_delayed_scan", "rows_pre_filter")


def node_work(steplog: DataFrame, slices: DataFrame, *, by_query: bool = False, fleet: Sequence[str] = ()) -> DataFrame:
    """Elapsed milliseconds and bytes per day and node, from the segments each slice ran."""
    seg = steplog.where("end_time > start_time").groupBy(
        *fleet, day_of("start_time").alias("day"), "slice", "query", "segment").agg(
        boundary_diff("millisecond", F.min("start_time"), F.max("end_time")).alias("ms"), F.sum("bytes").alias("bytes"))
    extra = ["query"] if by_query else []
    per_slice = seg.groupBy(*fleet, "day", "slice", *extra).agg(F.sum("ms").alias("ms"), F.sum("bytes").alias("bytes"))
    return per_slice.join(slices, [*fleet, "slice"]).groupBy(*fleet, "day", "node", *extra).agg(
        F.sum("ms").alias("elapsed_ms"), F.sum("bytes").alias("bytes"))


def node_work_hourly(steplog: DataFrame, slices: DataFrame, *, start=None, end=None, label_chars: int | None = None,
                     fleet: Sequence[str] = ()) -> DataFrame:
    """Steps, elapsed seconds, bytes and rows per hour and node, optionally per operator prefix."""
    keys = [hour_of("start_time").alias("hour")] + ([F.substring("label", 1, label_chars).alias("op")] if label_chars else [])
    names = [*fleet, "hour"] + (["op"] if label_chars else [])
    done = between(steplog, "start_time", start, end).where(unset_to_null("end_time").isNotNull())
    # per slice first: the node lookup then joins slices, not steps
    per_slice = done.groupBy(*fleet, *keys, "slice").agg(F.count("*").alias("steps"), F.sum("elapsed_time").alias("us"),
                                                         F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    s = per_slice.join(slices, [*fleet, "slice"]).groupBy(*names, "node").agg(
        F.sum("steps").alias("steps"), int_div(F.sum("us"), SECOND).alias("elapsed_s"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    return s.select(*names, "node", "steps", "elapsed_s", ratio("elapsed_s", "steps", 4).alias("elapsed_s_per_step"), "bytes",
                    ratio("bytes", "steps", 4).alias("bytes_per_step"), "rows", ratio("rows", "steps", 4).alias("rows_per_step"))


def node_deviation(hourly: DataFrame, *, fleet: Sequence[str] = ()) -> DataFrame:
    """Mean and standard deviation of hourly work per node (and operator, where present)."""
    keys = [*fleet, "node"] + (["op"] if "op" in hourly.columns else [])
    aggs = []
    for c in ("elapsed_s", "rows", "bytes", "steps"):
        aggs += [mean(c, 2).alias(f"avg_{c}"), rounded(F.stddev_samp(c), 2).alias(f"stddev_{c}")]
    return hourly.groupBy(*keys).agg(*aggs)


def network_retransmit(rexmitlog: DataFrame, slices: DataFrame, *, start=None, end=None, fleet: Sequence[str] = ()) -> DataFrame:
    """Retransmissions per day and node pair: count and megabytes."""
    per_pair = between(rexmitlog, "recordtime", start, end).groupBy(*fleet, day_of("recordtime").alias("day"), "src_slice", "dst_slice").agg(
        F.count("*").alias("n"), F.sum("len").alias("len"))
    src = slices.select(*fleet, F.col("slice").alias("src_slice"), F.col("node").alias("src"))
    dst = slices.select(*fleet, F.col("slice").alias("dst_slice"), F.col("node").alias("dst"))
    pair = F.concat(F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"))
    return per_pair.join(src, [*fleet, "src_slice"]).join(dst, [*fleet, "dst_slice"]).groupBy(*fleet, "day", pair.alias("pair")).agg(
        F.sum("n").alias("n"), rounded(F.sum("len") / 1048576.0, 2).alias("mbytes"))


def retransmit_deviation(daily: DataFrame, *, fleet: Sequence[str] = ()) -> DataFrame:
    """Mean and standard deviation of daily retransmissions per node pair."""
    return daily.groupBy(*fleet, "pair").agg(mean("n", 2).alias("avg_n"), rounded(F.stddev_samp("n"), 2).alias("stddev_n"))


def statement_rate(statementtext: DataFrame, *, per: str = "hour") -> DataFrame:
    """Statements and their rate per minute, by hour or day and leading word."""
    bucket = hour_of("starttime") if per == "hour" else day_of("starttime")
    return statementtext.where("sequence = 0").groupBy(bucket.alias(per), leading_word("text").alias("word")).agg(
        F.count("*").alias("n"), rounded(F.count("*") / (60.0 if per == "hour" else 1440.0), 4).alias("per_minute"))


def statement_timeline(querylog: DataFrame, steplog: DataFrame, queuelog: DataFrame, compilelog: DataFrame,
                       commitlog: DataFrame, *, query=None, as_of=None, lookback: float | None = None, fleet: Sequence[str] = ()) -> DataFrame:
    """Where each statement's time went: wall, steps, queue, execution, compile and commit.

    For given statements or a window (of the statements' start), only their transactions' commits are read on.
    """
    by_query, by_xid = [*fleet, "query"], [*fleet, "xid"]
    ms = lambda a, b: boundary_diff("millisecond", a, b)
    of = lambda log, end: only(since(log, end, as_of, lookback), query=query)
    q = only(recent(querylog, "starttime", as_of, lookback), query=query).select(*by_query, "xid", ms("starttime", "endtime").alias("wall_ms"))
    steps = of(steplog, "end_time").groupBy(*by_query).agg(ms(F.min("start_time"), F.max("end_time")).alias("steps_ms"))
    comp = of(compilelog, "endtime").groupBy(*by_query).agg(ms(F.min("starttime"), F.max("endtime")).alias("compile_ms"), F.sum("compile").alias("n_compiled"))
    queued = of(queuelog, "service_class_end_time").groupBy(*by_query).agg(F.sum("total_queue_time").alias("queue_us"), F.sum("total_exec_time").alias("exec_us"))
    commits = since(commitlog, "endtime", as_of, lookback)
    commits = commits if query is None and as_of is None else told_of(commits, q, by_xid)
    commits = commits.groupBy(*by_xid).agg(
        F.max(ms(F.coalesce(unset_to_null("startqueue"), F.col("startwork")), "startwork")).alias("commit_queue_ms"),
        F.max(ms("startwork", "endtime")).alias("commit_ms"))
    return (q.join(steps, by_query, "left").join(queued, by_query, "left").join(comp, by_query, "left").join(commits, by_xid, "left")
            .select(*by_query, "xid", "wall_ms", "steps_ms", "queue_us", "exec_us", "compile_ms", "n_compiled", "commit_queue_ms", "commit_ms"))


def compile_stats(compilelog: DataFrame, querylog: DataFrame | None = None, *, text_like: str | None = None,
                  by: tuple[str, ...] = ("compile",), fleet: Sequence[str] = ()) -> DataFrame:
    """Segments compiled or reused: count, statements and milliseconds per flag or statement."""
    log = compilelog
    if querylog is not None and text_like is not None:
        log = told_of(log, querylog.where(F.col("querytxt").ilike(text_like)), [*fleet, "query"])
    return log.groupBy(*fleet, *by).agg(F.count("*").alias("n"), F.count_distinct("query").alias("n_queries"),
                                        F.sum(boundary_diff("millisecond", "starttime", "endtime")).alias("ms"))


def broadcast_network(bcastlog: DataFrame) -> DataFrame:
    """Broadcast steps that sent packets and took at least a second."""
    secs = boundary_diff("second", "starttime", "endtime")
    return bcastlog.where((F.col("packets") > 0) & (secs > 0)).select("query", "slice", "step", "rows", "bytes", "packets", secs.alias("secs"))


def agg_steps(agglog: DataFrame, *, slice=None, tbl=None, limit: int | None = None) -> DataFrame:
    """Memory and slots of aggregate steps, smallest first."""
    out = only(agglog, slice=slice, tbl=tbl).select("query", "slice", "tbl", "segment", "bytes", "slots", "occupied", "maxlength",
                                                    "is_diskbased", "workmem", "type", "rows")
    return top(out, limit, "rows", "query", "slice", "tbl", "segment", "bytes", "slots")


def statements_where(querylog: DataFrame, *, pattern: str | None = None, start=None, end=None, userid=None,
                     limit: int | None = None, text_chars: int | None = None) -> DataFrame:
    """Statements by text pattern, time range or user, newest first."""
    q = only(between(querylog, "starttime", start, end), userid=userid)
    if pattern is not None:
        q = q.where(F.col("querytxt").ilike(pattern))
    out = q.select("query", "userid", "xid", "pid", "label", "starttime", "endtime", "aborted",
                   boundary_diff("second", "starttime", "endtime").alias("secs"), cut(trimmed("querytxt"), text_chars).alias("querytxt"))
    return top(out, limit, F.desc("starttime"), F.desc("query"))


def error_log(errorlog: DataFrame, *, start=None, end=None, pid=None, process: str | None = None, fleet: Sequence[str] = ()) -> DataFrame:
    """Recorded errors by time range, process id or process name."""
    return only(between(errorlog, "recordtime", start, end), pid=pid, process=process).select(
        *fleet, "userid", "process", "recordtime", "pid", "errcode", trimmed("file").alias("file"), "linenum",
        trimmed("context").alias("context"), trimmed("error").alias("error"))


def _siblings(statementtext: DataFrame, targets: DataFrame, fleet: Sequence[str], hours: float | None) -> DataFrame:
    """Statements of the targets' processes; with ``hours`` only those begun so long before or after a target of the process."""
    if hours is None:
        return told_of(statementtext, targets, [*fleet, "pid"])
    # a busy process has many targets: each statement is tested against the union of their time spans
    spans = targets.select(*fleet, "pid", *[(F.col(c) + F.expr(f"interval '{sign * int(hours * 3600)}' second")).alias(c)
                                            for c, sign in (("starttime", -1), ("endtime", 1))])
    return covered(statementtext, "starttime", spans, "starttime", "endtime", [*fleet, "pid"])


def review(targets: DataFrame, *, queuelog: DataFrame, querylog: DataFrame, commitlog: DataFrame, compilelog: DataFrame,
           statementtext: DataFrame, planlog: DataFrame, planinfo: DataFrame, steplog: DataFrame, stepsummary: DataFrame,
           alertlog: DataFrame, loaderrors: DataFrame, errorlog: DataFrame, sibling_hours: float | None = None,
           fleet: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Everything the logs hold about the ``targets`` statements, one DataFrame per log.

    Process ids are reused: ``sibling_hours`` keeps the statements of a target's process near the target in time.
    """
    by_query = lambda df: told_of(df, targets, [*fleet, "query"])
    return {
        "statements": targets,
        "queue": queue_wait_by_query(by_query(queuelog), querylog, waited_only=False, fleet=fleet),
        "commits": commit_rows(told_of(commitlog, targets, [*fleet, "xid"]), fleet=fleet),
        "compile": by_query(compilelog).select(*fleet, "userid", "xid", "pid", "query", "segment", "locus",
                                               boundary_diff("millisecond", "starttime", "endtime").alias("ms"), "compile"),
        "siblings": _siblings(statementtext, targets, fleet, sibling_hours).select(
            *fleet, "userid", "xid", "pid", "label", "starttime", "endtime", "sequence", "type", trimmed("text").alias("text")),
        "plan": by_query(planlog).select(*fleet, "userid", "query", "nodeid", "parentid", trimmed("plannode").alias("plannode"), trimmed("info").alias("info")),
        "plan_steps": by_query(planinfo),
        "steps": query_steps(by_query(steplog), fleet=fleet),
        "summary": query_summary(by_query(stepsummary), fleet=fleet),
        "alerts": alert_list(by_query(alertlog), fleet=fleet),
        "load_errors": by_query(loaderrors),
        "errors": error_log(covered(errorlog, "recordtime", targets, "starttime", "endtime", fleet), fleet=fleet),
    }


def abort_triage(querylog: DataFrame, *, pattern: str, sibling_hours: float | None = None, fleet: Sequence[str] = (),
                 **logs: DataFrame) -> dict[str, DataFrame]:
    """Aborted statements matching a text pattern and all that was logged around them."""
    targets = querylog.where((F.col("aborted") == 1) & F.col("querytxt").ilike(pattern))
    return review(targets, querylog=querylog, sibling_hours=sibling_hours, fleet=fleet, **logs)


def review_query(querylog: DataFrame, *, query=None, sibling_hours: float | None = None, fleet: Sequence[str] = (),
                 **logs: DataFrame) -> dict[str, DataFrame]:
    """All that was logged about given statements; about every statement when none is given."""
    return review(only(querylog, query=query), querylog=querylog, sibling_hours=sibling_hours, fleet=fleet, **logs)


def text_reassembly(querytext: DataFrame, *, max_chunks: int | None = None, fleet: Sequence[str] = ()) -> DataFrame:
    """Whole statement texts from their numbered chunks."""
    chunks = querytext if max_chunks is None else querytext.where(F.col("sequence") < max_chunks)
    return chunks.groupBy(*fleet, "query").agg(F.expr("listagg(text, '') within group (order by sequence)").alias("text"))


def cursor_activity(cursors: DataFrame, utilitytext: DataFrame, users: DataFrame, *, as_of, fleet: Sequence[str] = ()) -> DataFrame:
    """Open cursors: run time, result size, rows left to fetch and the declaring text.

    Of the utility log, only the texts of open cursors' transactions are put together.
    """
    c = cursors.groupBy(*fleet, "userid", "xid", "pid").agg(
        F.min("starttime").alias("start_time"), F.min("byte_count").alias("bytes"), F.min("row_count").alias("row_count"),
        F.min(F.col("row_count") - F.col("fetched_rows")).alias("remaining_rows"), F.min("fetched_rows").alias("fetched_rows"))
    owner = [*fleet, "pid", "xid"]
    t = told_of(utilitytext.where("text != 'begin;'"), cursors, owner).groupBy(*owner).agg(
        F.expr("listagg(text, '') within group (order by struct(starttime, sequence))").alias("query_text"))
    u = users.select(*fleet, F.col("usesysid").alias("userid"), F.col("usename").alias("user_name"))
    return c.join(t, owner).join(u, [*fleet, "userid"]).select(
        *fleet, "xid", "pid", "userid", "user_name", "start_time", boundary_diff("second", "start_time", at(as_of)).alias("run_s"), "bytes",
        rounded(F.col("bytes") / 1048576.0, 2).alias("mbytes"), rounded(F.col("bytes") / 1073741824.0, 2).alias("gbytes"),
        "row_count", "remaining_rows", "fetched_rows", "query_text")


def percent_of_max(df: DataFrame, col: str, *, out: str = "pct_of_max") -> DataFrame:
    """Each row's measure as a percentage of the largest one, a maximum of zero counting as one."""
    largest = df.select(F.max(col).cast("double").alias("m")).select(F.coalesce(F.nullif("m", F.lit(0.0)), F.lit(1.0)).alias("m")).scalar()
    return df.withColumn(out, rounded(F.col(col) * 100.0 / largest, 4))


def analyze_runs(analyzelog: DataFrame, utilitytext: DataFrame, statind: DataFrame, *, pattern: str = "analyze%",
                 fleet: Sequence[str] = ()) -> DataFrame:
    """Statistics runs started by matching statements, with the table's change counters."""
    ind = statind.select(*fleet, F.col("stairelid").alias("table_id"), "stairows", "staiins", "staidels")
    asked = told_of(analyzelog, utilitytext.where(F.col("text").ilike(pattern)), [*fleet, "xid"])
    return asked.join(ind, [*fleet, "table_id"], "left").select(
        *fleet, "userid", "xid", "database", "table_id", "status", "rows", "modified_rows", "threshold_percent", "starttime",
        "stairows", "staiins", "staidels")
