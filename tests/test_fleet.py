"""Reports over two clusters that reuse every id must equal the union of the reports over each."""

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import connections, layout, loads, performance, queue, transactions
from fleetgauge.plans.bindings import Inputs

from .conftest import DATA

AS_OF = "2024-02-01 00:00:00"
LATE = "2002-01-01 00:00:00"

# operator, its inputs, further arguments
CASES = {
    "conflicts": (transactions.conflicts, ["conflictlog", "class", "ns"], {}),
    "locks_held": (transactions.locks_held, ["locks", "class", "ns", "activity"], {}),
    "blocking_locks": (transactions.blocking_locks, ["locks", "txns", "class", "ns", "db", "recents"], {"as_of": AS_OF}),
    "blocked_by": (transactions.blocked_by, ["locks", "activity"], {"as_of": AS_OF}),
    "load_errors": (loads.load_errors, ["loaderrors", "class"], {}),
    "queue_wait": (queue.queue_wait_by_query, ["queuelog", "queue_querylog"], {}),
    "concurrency_peak": (queue.concurrency_peak, ["queuelog", "classcfg"], {"as_of": AS_OF, "horizon_days": 31}),
    "concurrency_hourly": (queue.concurrency_peak_hourly, ["queuelog", "classcfg"], {"as_of": AS_OF, "horizon_days": 3, "step_seconds": 5}),
    "concurrency_exact": (queue.concurrency_exact, ["queuelog"], {}),
    "concurrency_at": (queue.concurrency_at, ["queuelog", "classcfg"], {"as_of": AS_OF, "horizon_days": 5}),
    "alerts_by_table": (performance.alerts_by_table, ["alertlog", "scanlog", "distlog", "bcastlog", "tableinfo"], {"as_of": LATE}),
    "table_alerts": (performance.table_alerts, ["alertlog", "scanlog", "distlog", "bcastlog", "tableperm", "class", "ns"], {"as_of": LATE}),
    "slice_distribution": (layout.slice_distribution, ["tableperm", "class", "ns", "tableinfo"], {}),
    "table_info": (layout.table_info, ["tableperm", "class", "ns", "blocks", "attrs", "partitions"], {}),
    "largest_tables": (layout.largest_tables, ["tableperm", "class", "ns", "db", "blocks"], {}),
    "space_per_table": (layout.space_per_table, ["tableperm", "class", "ns", "db", "attrs", "blocks"], {}),
    "space_per_slice": (layout.space_per_slice, ["tableperm", "class", "ns", "db", "blocks"], {}),
    "maintenance_runs": (layout.maintenance_runs, ["vacuumlog", "tableperm", "class", "ns"], {}),
    "key_mismatch": (layout.key_mismatch, ["insertlog", "scanlog", "class", "ns", "attrs"], {}),
    "queue_trend_daily": (queue.queue_trend_daily, ["queuelog", "rules"], {}),
    "queue_trend_hourly": (queue.queue_trend_hourly, ["queuelog", "rules"], {}),
    "queue_avg_max": (queue.queue_avg_max, ["queuelog"], {}),
    "queue_resources": (queue.queue_resources_hourly, ["queuelog", "metrics", "cachelog"], {"as_of": AS_OF, "lookback": 20}),
    "rule_candidates": (queue.rule_candidates, ["metrics"], {}),
    "queue_state": (queue.queue_state, ["classcfg", "class_state", "rules"], {}),
    "commit_breakdown": (queue.queue_commit_breakdown, ["queue_querylog", "commitlog", "queuelog"], {}),
    "running_queries": (queue.running_queries, ["queue_state", "queue_querylog", "stepmetrics", "users", "utilitytext", "alertlog"], {}),
    "active_sessions": (queue.active_sessions, ["sessions", "recents"], {"as_of": AS_OF}),
    "timed_out": (queue.timed_out_returning, ["queue_state", "classcfg"], {}),
    "top_queries": (performance.top_queries, ["querylog", "alertlog"], {"as_of": LATE}),
    "top_by_event": (performance.top_queries, ["querylog", "alertlog"], {"by_event": True}),
    "top_resources": (performance.top_queries_resources, ["queue_querylog", "metrics", "alertlog", "utilitytext"], {"as_of": AS_OF, "lookback": 20}),
    "alert_bits": (performance.alert_bits, ["alertlog"], {}),
    "filters_used": (performance.filters_used, ["planlog", "planinfo", "scanlog"], {"as_of": "1996-01-01", "lookback": 700}),
    "query_steps": (performance.query_steps, ["steplog"], {}),
    "node_work": (performance.node_work, ["steplog", "slices"], {"by_query": True}),
    "node_work_hourly": (performance.node_work_hourly, ["steplog", "slices"], {"label_chars": 4}),
    "node_deviation": (lambda s, n, **f: performance.node_deviation(performance.node_work_hourly(s, n, **f), **f), ["steplog", "slices"], {}),
    "retransmit": (performance.network_retransmit, ["rexmitlog", "slices"], {}),
    "retransmit_deviation": (lambda r, n, **f: performance.retransmit_deviation(performance.network_retransmit(r, n, **f), **f), ["rexmitlog", "slices"], {}),
    "timeline": (performance.statement_timeline, ["queue_querylog", "steplog", "queuelog", "compilelog", "commitlog"], {}),
    "timeline_window": (performance.statement_timeline, ["queue_querylog", "steplog", "queuelog", "compilelog", "commitlog"], {"as_of": AS_OF, "lookback": 12}),
    "compile_stats": (performance.compile_stats, ["compilelog", "querylog"], {"text_like": "%select%"}),
    "texts": (performance.text_reassembly, ["querytext"], {}),
    "cursors": (performance.cursor_activity, ["cursors", "utilitytext", "users"], {"as_of": AS_OF}),
    "analyze_runs": (performance.analyze_runs, ["analyzelog", "utilitytext", "statind"], {"pattern": "analyze%facts%"}),
    "commit_stats": (transactions.commit_stats, ["commitlog"], {}),
    "reads_writes": (transactions.table_reads_writes, ["querylog", "scanlog", "deletelog", "insertlog", "conflictlog", "utilitytext", "commitlog"], {}),
    "conflict_timeline": (transactions.conflict_timeline, ["statementtext", "conflictlog"], {}),
    "lock_order": (transactions.lock_order, ["txns", "tableinfo"], {}),
    "connection_summary": (connections.connection_summary, ["connlog", "sessions"], {"as_of": AS_OF}),
    "open_sessions": (connections.open_sessions, ["connlog"], {}),
    "session_leakage": (connections.session_leakage, ["connlog"], {}),
    "load_performance": (loads.load_performance, ["filelog", "querylog"], {"as_of": LATE, "lookback": 2000}),
    "load_by_node": (loads.load_by_node, ["filelog", "slices"], {}),
    "transfer_histogram": (loads.transfer_histogram, ["filelog"], {}),
    "node_histogram": (loads.node_transfer_histogram, ["filelog", "slices"], {}),
    "file_gaps": (loads.file_gap_by_node, ["loadcommits", "slices"], {}),
    "last_load_errors": (loads.last_load_errors, ["loaderrors"], {}),
    "export_layout": (loads.export_layout, ["blocks", "tableinfo"], {}),
    "table_inspector": (layout.table_inspector, ["tableinfo", "blocks", "slices"], {}),
    "extended_info": (layout.extended_table_info, ["tableinfo", "class", "scanlog", "alertlog", "planinfo", "planlog", "constraints", "attrs", "tableperm", "slices"],
                      {"as_of": LATE}),
    "minimum_size": (layout.minimum_table_size, ["blocks", "class", "slices"], {}),
    "fragmentation": (layout.fragmentation, ["blocks", "slices", "tableperm", "db"], {}),
    "block_classes": (lambda b, n, t, **f: layout.block_classes(b, slices=n, tableinfo=t, per_table=True, **f), ["rawblocks", "slices", "tableinfo"], {}),
    "skew_by_table": (layout.skew_by_table, ["blocks"], {}),
    "slice_detail": (layout.table_slice_detail, ["blocks", "slices"], {}),
    "column_cost": (layout.column_block_cost, ["blocks", "attrs", "class", "ns"], {}),
    "scan_frequency": (layout.scan_frequency, ["tableinfo", "scanlog"], {}),
    "unscanned": (lambda t, s, n, p, **f: layout.unscanned_summary(
        t, s, layout.fleet_capacity_tb(n, p, **f) if f["fleet"] else layout.node_capacity_tb(n, p), **f), ["tableinfo", "scanlog", "slices", "partitions"], {}),
    "maintenance": (layout.maintenance_summary, ["vacuumlog", "tableperm", "db", "blocks", "txns"], {"as_of": AS_OF}),
}
_REVIEWED = ["queuelog", "commitlog", "compilelog", "statementtext", "planlog", "planinfo", "steplog", "stepsummary", "alertlog", "loaderrors", "errorlog"]


def _reviewed(part, **more):
    def build(querylog, *logs, **f):
        return performance.abort_triage(querylog, pattern="%error%", **dict(zip(_REVIEWED, logs)), **more, **f)[part]

    return build, ["queue_querylog", *_REVIEWED], {}


CASES |= {f"triage_{part}": _reviewed(part) for part in ("queue", "commits", "compile", "siblings", "plan", "plan_steps", "steps", "summary", "alerts", "errors")}
CASES["triage_near_siblings"] = _reviewed("siblings", sibling_hours=40 * 365 * 24)


def plain(frame):
    rows = frame.select(*sorted(frame.columns)).collect()
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", CASES)
def test_two_clusters_with_the_same_ids(spark, name):
    build, needs, more = CASES[name]
    bound = Inputs(spark, DATA)
    # one cluster's catalog is enough: the second cluster repeats its ids, with every third row missing
    one = [bound[n].drop("cluster_id") for n in needs]
    two = [f.where(F.pmod(F.xxhash64(*f.columns), F.lit(3)) != 0) if k == 0 else f for k, f in enumerate(one)]
    both = [a.withColumn("cluster_id", F.lit("a")).unionByName(b.withColumn("cluster_id", F.lit("b"))) for a, b in zip(one, two)]
    fleet = plain(build(*both, **more, fleet=("cluster_id",)))
    apart = build(*one, **more, fleet=()).withColumn("cluster_id", F.lit("a")).unionByName(build(*two, **more, fleet=()).withColumn("cluster_id", F.lit("b")))
    assert fleet and fleet == plain(apart)


def test_siblings_near_their_target(spark):
    """A process id is reused, by other servers and later: only what the process did around the target is its sibling."""
    at = lambda h: f"timestamp_ntz'2024-01-01 {h:02d}:00:00'"
    targets = spark.sql(f"select 'a' as cluster_id, 7L as pid, {at(5)} as starttime, {at(6)} as endtime union all select 'a', 7L, {at(12)}, {at(13)}")
    texts = spark.sql(" union all ".join(f"select '{c}' as cluster_id, {p}L as pid, {at(h)} as starttime, '{c}{p}-{h}' as text"
                                         for c in "ab" for p in (7, 8) for h in range(24)))
    near = performance._siblings(texts, targets, ["cluster_id"], 1)
    assert sorted(r.text for r in near.collect()) == sorted(f"a7-{h}" for h in (4, 5, 6, 7, 11, 12, 13, 14))
    assert performance._siblings(texts, targets, ["cluster_id"], None).count() == 24
