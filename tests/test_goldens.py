"""Small worked examples with known results."""

import datetime as dt

from pyspark.sql import functions as F

from fleetgauge.functions import alerts, holidays, temporal as tm, text
from fleetgauge.operators import connections, dims, layout, loads, performance, privileges, queue, transactions


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_outer_join_conditions(spark, rows):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "c1 int, a2 string")
    b = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "c1 int, b2 string")
    assert rows(dims.outer_join_on(a, b, ["c1"])) == [(1, "a", "A"), (2, "b", "B"), (3, "c", "C"), (4, "d", None), (5, "e", None)]
    only_first = [(1, "a", "A"), (2, "b", None), (3, "c", None), (4, "d", None), (5, "e", None)]
    assert rows(dims.outer_join_on(a, b, ["c1"], left_only=F.col("a2") == "a")) == only_first
    assert rows(dims.outer_join_on(a, b, ["c1"], right_only=F.col("b2") == "A")) == only_first


def test_sunday_week(spark):
    df = spark.createDataFrame([(ts("2015-08-01 23:59:45"),), (ts("2015-08-02 00:00:00"),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(tm.week_starting_sunday("t")).collect()] == ["2015-07-26", "2015-08-02"]


def test_host_name(spark):
    df = spark.createDataFrame([("http://www.google.com",), ("http://www.Example.com/x?y=1",), ("no url",), (None,)], "u string")
    assert [r[0] for r in df.select(text.host_name("u")).collect()] == ["www.google.com", "www.example.com", None, None]


def test_date_span(spark):
    df = spark.createDataFrame([(ts("2016-08-06"),), (ts("2016-08-16"),)], "d timestamp_ntz")
    r = dims.date_span(df, "d").first()
    assert (r.days, r.weeks, r.shifted) == (10, 2, dt.date(2016, 8, 26))


def test_boundaries_are_counted_not_elapsed_units(spark):
    df = spark.createDataFrame([(ts("2024-01-01 00:59:59"), ts("2024-01-01 01:00:01"))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(*[tm.boundary_diff(u, "a", "b").alias(u) for u in ("second", "minute", "hour", "day", "month")]).first()
    assert tuple(r) == (2, 1, 1, 0, 0)
    before = spark.createDataFrame([(ts("1969-12-31 23:59:59"), ts("1970-01-01 00:00:00"))], "a timestamp_ntz, b timestamp_ntz")
    assert before.select(tm.boundary_diff("day", "a", "b")).first()[0] == 1


def test_human_duration(spark):
    assert spark.range(1).select(tm.human_duration(F.lit(90061))).first()[0] == "1 days 1hrs 1mins 1secs"


def test_group_sums_appended(spark, rows):
    t = spark.createDataFrame([(1, 10), (1, 20), (2, 100), (2, 200)], "a int, b long")
    assert rows(dims.append_group_sums(t, "a", "b")) == [(1, 10), (1, 20), (1, 30), (2, 100), (2, 200), (2, 300)]
    more = t.unionByName(spark.createDataFrame([(2, 30)], "a int, b long"))
    assert rows(more.groupBy("a").agg(F.sum("b"))) == [(1, 30), (2, 330)]


def test_calendar(spark):
    cal = dims.calendar_dim(spark)
    assert cal.count() == 54787
    lo, hi = cal.agg(F.min("date"), F.max("date")).first()
    assert (lo, hi) == (dt.date(1900, 1, 1), dt.date(2049, 12, 31))
    day = cal.where("id = 20160704").first()
    assert (day.day_name, day.month_name, day.holiday_flag, day.weekend_flag) == ("Monday", "July", True, False)


def test_holidays(spark):
    days = ["2021-12-31", "2022-01-01", "2021-07-05", "2021-07-04", "2024-01-15", "2024-05-27", "2024-11-28", "2020-06-19", "2024-06-19", "2024-06-20"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "d date")
    assert [r[0] for r in df.select(holidays.is_holiday(F.col("d"))).collect()] == [True, False, True, False, True, True, True, False, True, False]


def test_minimum_table_size(spark):
    block = "tbl int, slice int, col int, unsorted int"
    def blocks(tbl, slices, cols, regions):
        return [(tbl, s, c, r) for s in range(slices) for c in range(cols) for r in range(regions)]
    data = blocks(1, 4, 9, 1) + blocks(2, 4, 11, 2) + blocks(3, 1, 44, 2) + blocks(4, 2, 5, 1)
    classes = spark.createDataFrame([(1, "cat", 0), (2, "date", 1), (3, "appointment", 1), (4, "copy", 8)], "oid int, relname string, reldiststyle int")
    slices = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3)], "node int, slice int")
    got = {r.table_id: (r.minimum_size, r.actual_size) for r in layout.minimum_table_size(spark.createDataFrame(data, block), classes, slices).collect()}
    assert got == {1: (36, 36), 2: (88, 88), 3: (88, 88), 4: (10, 10)}


def test_commit_sentinel(spark):
    c = spark.createDataFrame([
        (1, -1, ts("2016-09-17 00:59:07.000"), ts("2016-09-17 00:59:09.147"), ts("2016-09-17 00:59:10.732"), 1),
        (1, 0, ts("2000-01-01 00:00:00"), ts("2016-09-17 00:59:09.200"), ts("2016-09-17 00:59:09.300"), 0)],
        "xid int, node int, startqueue timestamp_ntz, startwork timestamp_ntz, endtime timestamp_ntz, queuelen int")
    got = {r.node: (r.queue_ms, r.commit_ms, r.startqueue) for r in transactions.commit_rows(c).collect()}
    assert got[-1][:2] == (2147, 1585) and got[0] == (0, 100, None)


def test_alert_bits_are_repeat_safe(spark):
    names = [a[0] for a in alerts.ALERTS]
    log = spark.createDataFrame([(1, names[2] + ": x"), (1, names[2]), (1, names[5]), (2, "unheard of")], "query int, event string")
    got = {r.query: (r.mask, r.alert) for r in performance.alert_bits(log.withColumn("event_time", F.lit(None).cast("timestamp_ntz"))).collect()}
    assert got == {1: (36, "NL Stats"), 2: (0, "")}


def test_transfer_buckets(spark, rows):
    f = spark.createDataFrame([(0, 119_000_000), (0, 120_000_000), (0, 359_000_000), (0, 360_000_000)], "slice int, transfer_time long")
    assert rows(loads.transfer_histogram(f.withColumn("query", F.lit(1)))) == [("0_1", 1), ("2_5", 2), ("6_plus", 1)]


def test_rule_candidate_rounds_up(spark):
    values = [(2, 5, i % 100) for i in range(990)] + [(2, 5, 4000), (2, 5, 990000)]
    df = spark.createDataFrame(values, "userid int, service_class int, io_skew long")
    r = queue.rule_candidates(df, columns=("io_skew",)).first()
    assert (r.p99, r.candidate, r.pmax, r.rule_order) == (99.0, 100.0, 990000.0, 1)


def _queue(spark, spans):
    data = [(2, 6, s, ts(f"2024-01-01 {a}"), ts(f"2024-01-01 {b}")) for a, b, s in spans]
    return spark.createDataFrame(data, "userid int, service_class int, slot_count int, service_class_start_time timestamp_ntz, service_class_end_time timestamp_ntz").withColumns(
        {"total_queue_time": F.lit(0), "queue_end_time": F.col("service_class_start_time")})


def _config(spark):
    return spark.createDataFrame([(6, 20)], "service_class int, num_query_tasks int")


def test_end_frees_slot_before_start_at_same_instant(spark):
    q = _queue(spark, [("10:00:00", "10:10:00", 3), ("10:10:00", "10:20:00", 4)])
    r = queue.concurrency_exact(q).first()
    assert (r.max_slots, r.max_slots_ts) == (4, ts("2024-01-01 10:10:00"))
    p = queue.concurrency_peak(q, _config(spark), as_of="2024-01-02 00:00:00").first()
    assert (p.max_slots, p.max_slots_ts, p.configured_slots) == (4, ts("2024-01-01 10:19:55"), 20)


def test_short_statement_between_grid_instants_is_only_in_the_exact_maximum(spark):
    q = _queue(spark, [("10:00:00", "10:30:00", 1), ("10:00:01", "10:00:03", 9)])
    assert queue.concurrency_exact(q).first().max_slots == 10
    assert queue.concurrency_peak(q, _config(spark), as_of="2024-01-02 00:00:00").first().max_slots == 1


def test_long_statement_reaches_into_every_hour(spark):
    q = _queue(spark, [("09:30:00", "12:15:00", 2), ("10:10:00", "10:20:00", 5)])
    got = {r.hour: r.max_slots for r in queue.concurrency_peak_hourly(q, _config(spark), as_of="2024-01-02 00:00:00").collect()}
    assert got == {"9:00 - 9:59": 2, "10:00 - 10:59": 7, "11:00 - 11:59": 2, "12:00 - 12:59": 2}


def test_reused_process_id_gives_separate_sessions(spark):
    def ev(event, at, duration=0):
        return (event, ts(at), "h ", "1", 7, "db", "u", duration)
    log = spark.createDataFrame([
        ev("initiating session", "2024-01-01 10:00:00"), ev("authenticated", "2024-01-01 10:00:01"), ev("disconnecting session", "2024-01-01 11:00:00", 90061000000),
        ev("initiating session", "2024-03-01 10:00:00"), ev("authenticated", "2024-03-01 10:00:02")],
        "event string, recordtime timestamp_ntz, remotehost string, remoteport string, pid int, dbname string, username string, duration long").withColumns(
        {"authmethod": F.lit("password"), "mtu": F.lit(1500), "sslversion": F.lit(""), "sslcipher": F.lit(""), "application_name": F.lit("")})
    live = spark.createDataFrame([(7, "u", "db", ts("2024-03-01 10:00:00"))], "process int, user_name string, db_name string, starttime timestamp_ntz")
    got = [(r.session_no, r.current_state, r.duration) for r in connections.connection_summary(log, live, as_of="2024-03-01 10:01:02").orderBy("session_no").collect()]
    assert got == [(1, "Disconnected", "1 days 1hrs 1mins 1secs"), (2, "Active", "0 days 0hrs 1mins 0secs")]
    assert [r.connected for r in connections.open_sessions(log).orderBy("connect_time").collect()] == ["N", "Y"]


def test_quote_ident(spark):
    df = spark.createDataFrame([("abc_1",), ("Abc",), ('we"ird',), ("1a",)], "n string")
    assert [r[0] for r in df.select(text.quote_ident("n")).collect()] == ["abc_1", '"Abc"', '"we""ird"', '"1a"']


def test_grant_letters_round_trip(spark):
    letters = "".join(x for x, _, _ in privileges.LETTERS)
    entries = spark.createDataFrame([(1, "o", "s", "t", "table", "u1", "o", letters, "u1", 1), (1, "o", "s", "t", "table", "u2", "o", "arwdRxt", "u2", 2),
                                     (1, "o", None, "d", "database", "u3", "o", "C*T*", "u3", 1)],
                                    "cluster_id int, object_owner string, schema_name string, object_name string, object_type string, grantee string, grantor string, "
                                    "privilege string, grantee_quoted string, grant_seq int")
    defacl = spark.createDataFrame([], "cluster_id int, defacluser long, defaclnamespace long, defaclobjtype string")
    users = spark.createDataFrame([], "cluster_id int, usesysid long, usename string")
    ddl = {r.grantee: r.ddl for r in privileges.grant_revoke_text(entries, defacl, users, acting_user="o").where("ddl_type = 'grant'").collect()}
    for _, word, _ in privileges.LETTERS:
        assert f"GRANT {word} on " in ddl["u1"]
    assert ddl["u2"] == "GRANT ALL on s.t to u2;" and ddl["u3"] == "GRANT ALL on database d to u3 with grant option;"
