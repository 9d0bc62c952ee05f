"""Relations that must hold between reports."""

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import connections, layout, privileges, queue
from fleetgauge.operators.rows import recent
from fleetgauge.plans.bindings import Inputs

from .conftest import DATA


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, DATA)


def test_grid_peak_never_above_exact_peak(spark):
    i = Inputs(spark, DATA)
    grid = {r.service_class: r.max_slots for r in queue.concurrency_peak(i.queuelog, i.classcfg, as_of="2024-02-01 00:00:00", horizon_days=31).collect()}
    exact = {r.service_class: r.max_slots for r in queue.concurrency_exact(i.queuelog).collect()}
    slots = {r.service_class: r.s for r in i.queuelog.groupBy("service_class").agg(F.sum("slot_count").alias("s")).collect()}
    assert grid and all(grid[c] <= exact[c] <= slots[c] for c in grid)


def test_slice_shares_add_up(spark):
    i = Inputs(spark, DATA)
    sums = layout.slice_distribution(i.tableperm, i["class"], i.ns, i.tableinfo).groupBy("table_id").agg(F.sum("pct").alias("p")).collect()
    assert sums and all(abs(r.p - 100) < 0.1 for r in sums)


def test_every_authenticated_session_is_reported(spark):
    i = Inputs(spark, DATA)
    n = connections.numbered_sessions(i.connlog).where("event = 'authenticated'").select("pid", "dbname", "remotehost", "remoteport", "username", "session_no").distinct().count()
    assert connections.connection_summary(i.connlog, i.sessions, as_of="2024-02-01").count() == n


def test_listed_users_match_the_compact_report(spark):
    i = Inputs(spark, DATA)
    args = (i["class"], i.ns, i.users, i.groups)
    rights = list(privileges.TABLE_RIGHTS)
    compact = privileges.effective_table_privileges(*args).where("principal = 'u52' and principal_kind = 'user'")
    spelled = privileges.effective_table_privileges(*args, only_users=["u52"])
    cols = ["cluster_id", "object_name", *rights]
    assert compact.select(*cols).exceptAll(spelled.select(*cols)).count() == 0
    public = privileges.effective_table_privileges(*args).where("principal = 'PUBLIC'").select("cluster_id", "object_name")
    known = spelled.select("cluster_id", "object_name")
    assert public.where("cluster_id = 2").exceptAll(known).count() == 0


def test_no_query_pairs_everything_with_everything(spark):
    from __spark_entry__ import queries
    picked = ["q06_concurrency_peak", "q13_running_queries", "qp04_alerts_by_table", "qp26_percent_of_max", "k06_blocking_locks", "k07_blocked_by",
              "d02_table_info", "d14_unscanned_summary", "g05_effective_object_privileges", "j08_instant_in_interval"]
    for name in picked:
        plan = queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_time_bound_reaches_the_file_scan(spark):
    from fleetgauge.sources.scan import time_bounded_scan
    plan = time_bounded_scan(spark, f"{DATA}/events.parquet", "ts", as_of="2024-02-01", lookback_days=7, columns=["event_id", "ts"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), LessThanOrEqual(ts" in plan and "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_window_needs_a_reference_time_and_ends_there(spark):
    rows = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, n) as ts, n from range(1, 11) as t(n)")
    with pytest.raises(ValueError):
        recent(rows, "ts", None, 3)
    assert [r["n"] for r in recent(rows, "ts", "2024-01-06", 2).orderBy("n").collect()] == [3, 4, 5]
    assert recent(rows, "ts", "2024-01-06", None).count() == 5 and recent(rows, "ts", None, None).count() == 10


def test_horizon_reaches_the_file_scan(spark, inputs, tmp_path):
    inputs.queuelog.write.parquet(str(tmp_path / "q"))
    log = spark.read.parquet(str(tmp_path / "q"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = queue.concurrency_peak(log, inputs.classcfg, as_of="2024-01-20 00:00:00")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(service_class_start_time" in plan and "GreaterThan(service_class_end_time" in plan


def test_tables_without_a_row_on_slice_zero_are_reported(spark, inputs):
    perm = inputs.tableperm.where("slice != 0")
    whole = layout.fragmentation(inputs.blocks, inputs.slices, inputs.tableperm, inputs.db).orderBy("tbl").collect()
    part = layout.fragmentation(inputs.blocks, inputs.slices, perm, inputs.db).orderBy("tbl").collect()
    listed = {r["id"] for r in perm.select("id").distinct().collect()}
    assert whole and part == [r for r in whole if r["tbl"] in listed]
    runs = layout.maintenance_summary(inputs.vacuumlog, perm, inputs.db, inputs.blocks, inputs.txns, as_of="2002-01-01 00:00:00")
    assert runs.where("table_name is null").count() == runs.where(~F.col("table_id").isin(*listed)).count()


def test_commit_breakdown_adds_up_beyond_64_bits(spark):
    n = 20_000
    when = lambda s: f"timestamp_ntz '{s}'"
    log = spark.range(n).selectExpr("id as query", "id as xid", f"{when('2024-01-01 00:00:00')} as starttime", f"{when('2024-01-01 00:00:02')} as endtime")
    queued = spark.range(n).selectExpr("id as query", "7 as service_class", f"{when('2024-01-01 00:00:00')} as service_class_start_time",
                                       f"{when('2024-01-01 00:00:00')} as queue_start_time", f"{when('2024-01-01 00:00:01')} as queue_end_time",
                                       f"{when('2024-01-01 00:00:02')} as service_class_end_time")
    commits = spark.range(n).selectExpr("id as xid", "0 as node", f"{when('1994-01-01 00:00:00')} as startqueue",
                                        f"{when('1994-01-01 00:00:01')} as startwork", f"{when('1994-01-01 00:00:03')} as endtime")
    row, = queue.queue_commit_breakdown(log, commits, queued).collect()
    span = -(10_957 * 86_400 - 3) * 1_000_000
    assert row.total_us == (n - 1) * span < -2 ** 63 and row.n_commits == n - 1
    assert row.queue_us == (n - 1) * 1_000_000 and row.commit_us == (n - 1) * 2_000_000


def test_acl_entries_are_dealt_to_all_tasks_before_they_are_parsed(spark):
    from fleetgauge.plans import catalog_reports
    i = Inputs(spark, DATA)
    plan = privileges.grant_revoke_text(catalog_reports._entries(i), i.defacl, i.users)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1                # one reading serves grants and revokes
    dealt = plan.index("RepartitionByExpression")
    assert "Generate inline" in plan[:dealt] and plan[dealt:].count("Generate posexplode") == 6
