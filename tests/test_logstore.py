"""Logs stored by day and statement: the same reports, fewer files and no shuffles."""

import uuid

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import performance, queue
from fleetgauge.operators.rows import recent, since
from fleetgauge.plans.bindings import Inputs
from fleetgauge.session import filter_at_scans, shared_dir
from fleetgauge.sources.logstore import exchanges, store_log, use_buckets

from .conftest import DATA

FLEET = ("cluster_id",)
TIMES = {"queuelog": "service_class_end_time", "queue_querylog": "starttime", "scanlog": "starttime", "alertlog": "event_time", "steplog": "end_time",
         "compilelog": "endtime", "cachelog": "starttime", "commitlog": "endtime", "metrics": None, "planlog": None, "planinfo": None, "utilitytext": None}
XID = {"commitlog", "utilitytext"}


@pytest.fixture(scope="module")
def logs(spark):
    """Two clusters with the same ids: as frames and as stored tables."""
    bound = Inputs(spark, DATA)
    plain, stored = {}, {}
    for name, ts in TIMES.items():
        log = bound[name]
        if name in ("scanlog", "alertlog", "steplog", "compilelog"):       # a few weeks of their years: a day is a folder
            log = log.where(F.col(ts).between(F.lit("1995-11-15").cast("timestamp_ntz"), F.lit("1996-01-05").cast("timestamp_ntz")))
        elif name == "commitlog":
            log = log.where("xid < 60")
        both = log.withColumn("cluster_id", F.lit("a")).unionByName(log.where(F.pmod(F.xxhash64(*log.columns), F.lit(3)) != 0).withColumn("cluster_id", F.lit("b")))
        plain[name] = both
        stored[name] = store_log(both, f"t_{name}_{uuid.uuid4().hex[:8]}", ts=ts, keys=("cluster_id", "xid") if name in XID else ("cluster_id", "query"),
                                 buckets=4, path=shared_dir(spark, name))
    return plain, stored


@pytest.fixture
def shuffled_joins(spark):
    """No join is small enough to broadcast, as on a large fleet."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    use_buckets(spark)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


WINDOW = {"as_of": "2024-01-20 06:00:00", "lookback": 9, "fleet": FLEET}
OLD = {"as_of": "1996-01-01 00:00:00", "lookback": 30, "fleet": FLEET}
# report, logs, arguments, columns by which it may still shuffle (its own groups, and transactions)
REPORTS = {
    "q09": (queue.queue_resources_hourly, ["queuelog", "metrics", "cachelog"], WINDOW, {"exec_hour", "source_query", "_groupingexpression"}),
    "q12": (queue.queue_commit_breakdown, ["queue_querylog", "commitlog", "queuelog"], {"fleet": FLEET}, {"xid", "day"}),
    "qp02": (performance.top_queries_resources, ["queue_querylog", "metrics", "alertlog", "utilitytext"], WINDOW, {"xid", "fingerprint", "last_query"}),
    "qp08": (performance.filters_used, ["planlog", "planinfo", "scanlog"], OLD, {"table", "filter"}),
    "qp17": (performance.statement_timeline, ["queue_querylog", "steplog", "queuelog", "compilelog", "commitlog"], WINDOW, {"xid"}),
    "qp10": (performance.query_steps, ["steplog"], {"fleet": FLEET}, set()),
    "qp06": (performance.alert_bits, ["alertlog"], {"fleet": FLEET}, set()),
}


def rows(df):
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", REPORTS)
def test_reports_from_the_store(spark, logs, shuffled_joins, name):
    build, needs, more, own = REPORTS[name]
    plain, stored = logs
    report = build(*[stored[n] for n in needs], **more)
    found = rows(report)
    assert found and found == rows(build(*[plain[n] for n in needs], **more))
    left = [x for x in exchanges(report) if not any(f" {c}#" in x for c in own)]
    assert left == [], left                                            # nothing is dealt by statement anew
    assert len(exchanges(report)) < len(exchanges(build(*[plain[n] for n in needs], **more)))


def partitions(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [p.split("], ")[0] for p in plan.split("PartitionFilters: [")[1:]]


def test_window_opens_its_days_only(spark, logs):
    plain, stored = logs
    for bound in (recent, since):
        log = bound(stored["queuelog"], "service_class_end_time", "2024-01-20 06:00:00", 2)
        assert "service_class_end_time__day" in partitions(log)[0]
        days = {r[0] for r in log.select(F.regexp_extract(F.input_file_name(), "__day=([0-9-]+)", 1)).distinct().collect()}
        assert days and min(days) >= "2024-01-18" and (bound is since or max(days) <= "2024-01-20")
        assert log.count() == bound(plain["queuelog"], "service_class_end_time", "2024-01-20 06:00:00", 2).count()
    assert partitions(recent(stored["queuelog"], "queue_start_time", "2024-01-20", 2))[0] == ""       # another time: no day is certain


def test_days_are_added_in_the_same_layout(spark):
    log = Inputs(spark, DATA).queuelog.withColumn("cluster_id", F.lit("a"))
    name = f"t_days_{uuid.uuid4().hex[:8]}"
    parts = [log.where(F.dayofmonth("queue_start_time") % 2 == k) for k in (0, 1)]
    store_log(parts[0], name, ts="queue_start_time", buckets=4, path=shared_dir(spark, "days"))
    whole = store_log(parts[1].withColumn("queue_start_time", F.col("queue_start_time")), name, ts="queue_start_time", buckets=4, append=True)
    assert rows(whole.drop("queue_start_time__day")) == rows(log)
    files = whole.groupBy(F.input_file_name().alias("f")).agg(F.count_distinct("queue_start_time__day").alias("days"))
    assert files.agg(F.max("days")).first()[0] == 1
    undated = store_log(log.limit(3).withColumn("queue_start_time", F.lit(None).cast("timestamp_ntz")), f"{name}_n", ts="queue_start_time", buckets=2,
                        path=shared_dir(spark, "undated"))
    assert undated.count() == 3 and recent(undated, "queue_start_time", "2030-01-01", None).count() == 0


@pytest.fixture
def filtered_scans(spark):
    """Every join may filter its scans, and none is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    names = ["spark.sql.optimizer.runtime.bloomFilter." + x for x in ("enabled", "creationSideThreshold", "applicationSideScanSizeThreshold")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda large: filter_at_scans(spark, large_mb=large)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name in names:
        spark.conf.unset(name)


def test_scans_of_plans_are_filtered_by_the_window(spark, filtered_scans):
    """A Bloom filter of the window's statements stands at the scans of the plan logs; fewer rows leave them for a shorter window."""
    bound = Inputs(spark, DATA)
    logs = []
    for n in ("planlog", "planinfo", "scanlog"):
        path = shared_dir(spark, f"t-{n}")
        bound[n].write.parquet(path)
        logs.append(spark.read.parquet(path))
    report = lambda days: performance.filters_used(*logs, as_of="1996-01-01", lookback=days)
    filtered_scans(1 << 20)
    unfiltered = report(200)
    assert "might_contain" not in unfiltered._jdf.queryExecution().optimizedPlan().toString()       # the scan is not large enough
    want = rows(unfiltered)
    filtered_scans(0)
    filtered = report(200)
    assert "might_contain" in filtered._jdf.queryExecution().optimizedPlan().toString() and rows(filtered) == want and want

    def left_the_scans(df):
        """Rows written to shuffles, summed over the final plan."""
        df.collect()
        plan, total = df._jdf.queryExecution().executedPlan(), 0
        waiting = [plan.executedPlan() if hasattr(plan, "executedPlan") else plan]
        while waiting:
            node = waiting.pop()
            name = node.getClass().getSimpleName()
            if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
                waiting.append(node.plan())
                continue
            if name == "ShuffleExchangeExec":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            waiting += [children.apply(k) for k in range(children.size())]
        return total

    few, many = left_the_scans(report(5)), left_the_scans(report(2000))
    assert 0 < few < many / 2
