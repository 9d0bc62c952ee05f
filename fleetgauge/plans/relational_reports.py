"""Projection, join, aggregate, window, sort, set and function constructs, and the dimensions."""

from pyspark.sql import Window as W, functions as F

from ..functions.alerts import alert_bit
from ..functions.numeric import percent, rounded, total_if
from ..functions.scalar import register_scalar, url_host_function
from ..functions.temporal import US, at, boundary_diff, epoch_us, hour_of, human_duration, int_div, week_starting_sunday
from ..functions.text import host_name, leading_word, quote_ident
from ..operators import dims, layout, ordered, queue
from ..operators.rows import newest, only, top
from .registry import add

# ---- projections, filters, predicates
add("p01_computed_projection", lambda i: i.queuelog.select(
    "query", int_div("total_queue_time", 1000000).alias("queue_s"), (F.col("total_queue_time") + F.col("total_exec_time")).alias("total_us")), """
    select query, total_queue_time // 1000000 as queue_s, total_queue_time + total_exec_time as total_us from $queuelog""")
add("p02_alias_reuse", lambda i: i.queuelog.withColumn("secs", int_div("total_exec_time", 1000000)).where("secs > 3600").groupBy("secs").agg(
    F.count("*").alias("n")), "select total_exec_time // 1000000 as secs, count(*) as n from $queuelog where total_exec_time // 1000000 > 3600 group by 1")
add("p03_boolean_predicates", lambda i: i.lineitem.where(
    ((F.col("l_quantity") > 25) & ~(F.col("l_returnflag") == "N")) | (F.col("l_discount") <= 0.01)).select("l_orderkey", "l_linenumber", "l_quantity"), """
    select l_orderkey, l_linenumber, l_quantity from lineitem where (l_quantity > 25 and not l_returnflag = 'N') or l_discount <= 0.01""")
add("p04_like_ilike", lambda i: i.querylog.where(
    F.col("querytxt").ilike("select%") | F.col("querytxt").like("%c1%") & ~F.col("querytxt").ilike("%URGENT") | F.col("querytxt").like("padb\\_%")).select("query", "querytxt"), """
    select query, querytxt from $querylog where querytxt ilike 'select%' or querytxt like '%c1%' and querytxt not ilike '%URGENT' or querytxt like 'padb\\_%' escape '\\'""")
add("p05_in_lists", lambda i: i.lineitem.where(F.col("l_linenumber").isin(1, 3, 5) & ~F.col("l_returnflag").isin("R", "N")).select("l_orderkey", "l_linenumber"),
    "select l_orderkey, l_linenumber from lineitem where l_linenumber in (1, 3, 5) and l_returnflag not in ('R', 'N')")
add("p06_between", lambda i: i.orders.where(
    F.col("o_totalprice").between(100000, 300000) & F.col("o_orderdate").between(at("1996-01-01"), at("1999-12-31"))).select("o_orderkey", "o_totalprice"), """
    select o_orderkey, o_totalprice from orders where o_totalprice between 100000 and 300000 and o_orderdate between timestamp '1996-01-01' and timestamp '1999-12-31'""")
add("p07_null_and_truth", lambda i: i.attrs.join(i.attrdefaults, (F.col("attrelid") == F.col("adrelid")) & (F.col("attnum") == F.col("adnum")), "left").where(
    F.col("adsrc").isNull() & F.expr("attnotnull is true")).select("attrelid", "attnum"), """
    select attrelid, attnum from $attrs left join $attrdefaults on attrelid = adrelid and attnum = adnum where adsrc is null and attnotnull is true""")
add("p08_case_decode", lambda i: i["class"].select(
    "oid", F.expr("decode(reldiststyle, 0, 'EVEN', 1, 'KEY', 8, 'ALL')").alias("style"),
    F.when(F.col("reltuples") > 500, "big").when(F.col("relkind") == "v", "view").otherwise("small").alias("size_class")), """
    select oid, case reldiststyle when 0 then 'EVEN' when 1 then 'KEY' when 8 then 'ALL' end as style,
           case when reltuples > 500 then 'big' when relkind = 'v' then 'view' else 'small' end as size_class from $class""")
add("p09_distinct", lambda i: i.scanlog.select("tbl", "type").distinct(), "select distinct tbl, type from $scanlog")
add("p10_ordinal_grouping", lambda i: i.spark.sql(
    "select database, hour(starttime) as hour, count(*) as n from {log} group by 1, 2", log=i.querylog),
    "select database, cast(hour(starttime) as int) as hour, count(*) as n from $querylog group by 1, 2")
add("p11_scalar_subquery", lambda i: i.partitions.select("diskno", percent("used", i.partitions.select(F.sum("used")).scalar()).alias("pct")),
    "select diskno, round(used * 100.0 / (select sum(used) from $partitions), 4) as pct from $partitions")
add("p12_optional_filters", lambda i: only(i.querylog, database="F", label=None, aborted=[0, 1]).select("query", "database", "label"),
    "select query, database, label from $querylog where database = 'F' and aborted in (0, 1)")

# ---- joins
add("j01_inner_multi_key", lambda i: i.scanlog.join(i.planinfo, ["userid", "query", "segment", "step"]).groupBy("nodeid").agg(
    F.count("*").alias("n"), F.sum("rows").alias("rows")), """
    select nodeid, count(*) as n, cast(sum(rows) as bigint) as rows from $scanlog s join $planinfo i
    on s.userid = i.userid and s.query = i.query and s.segment = i.segment and s.step = i.step group by 1""")
add("j02_left_outer", lambda i: i.tableinfo.join(i.blocks.groupBy(F.col("tbl").alias("table_id")).agg(F.count("*").alias("mb")), "table_id", "left").select("table_id", "mb"),
    "select table_id, mb from $tableinfo left join (select tbl, count(*) as mb from $blocks group by 1) on tbl = table_id")
add("j03_using", lambda i: i.queuelog.join(i.metrics, ["userid", "service_class", "query"]).join(i.classcfg, ["service_class"]).select(
    "query", "name", "return_row_count"), """
    select query, name, return_row_count from $queuelog join $metrics using (userid, service_class, query) join $classcfg using (service_class)""")
add("j04_on_filter_keeps_rows", lambda i: dims.outer_join_on(
    i.customer.select("c_custkey", "c_mktsegment"), i.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_open")),
    ["c_custkey"], left_only=F.col("c_mktsegment") == "HOUSEHOLD"), """
    select c_custkey, c_mktsegment, n_open from customer left join (select o_custkey, count(*) as n_open from orders where o_orderstatus = 'P' group by 1)
    on o_custkey = c_custkey and c_mktsegment = 'HOUSEHOLD'""")
add("j05_filtered_outer", lambda i: dims.outer_join_on(
    i.tableinfo.select("table_id", "database"), i.constraints.select(F.col("conrelid").alias("table_id"), "contype"), ["table_id"], right_only=F.col("contype") == "p"), """
    select table_id, database, contype from $tableinfo left join $constraints on conrelid = table_id and contype = 'p'""")
add("j06_comma_join", lambda i: i.spark.sql(
    "select p.oid, l.lanname from {proc} p, {lang} l where p.prolang = l.oid and p.cluster_id = l.cluster_id", proc=i.proc, lang=i.languages),
    "select p.oid, l.lanname from $proc p, $languages l where p.prolang = l.oid and p.cluster_id = l.cluster_id")
add("j07_one_row_side", lambda i: i.blocks.groupBy("slice").agg(F.count("*").alias("n")).select(
    "slice", "n", (F.col("n") / i.slices.select(F.count_distinct("node")).scalar()).alias("n_per_node")), """
    select slice, n, n / nodes as n_per_node from (select slice, count(*) as n from $blocks group by 1) cross join (select count(distinct node) as nodes from $slices)""")
add("j08_instant_in_interval", lambda i: queue.concurrency_at(i.queuelog, i.classcfg, as_of="2024-02-01 00:00:00", step_seconds=900, horizon_days=31), """
    select service_class, make_timestamp(g) as instant, cast(sum(slot_count) as bigint) as slots
    from (select service_class, slot_count, unnest(range(epoch_us(service_class_start_time) + 900000000 - 1 - (epoch_us(service_class_start_time) + 900000000 - 1) % 900000000,
                 epoch_us(service_class_end_time), 900000000)) as g from $queuelog where userid > 1)
    where g < epoch_us(timestamp '2024-02-01') group by 1, 2""")
_waits = lambda i: i.locks.where("not granted").groupBy("relation", F.col("mode").alias("waiting_mode")).agg(F.count("*").alias("n_waiting"))
add("j09_pattern_residual", lambda i: i.locks.where("granted").groupBy("relation", "mode").agg(F.count("*").alias("n_held")).join(_waits(i), "relation").where(
    F.col("mode").like("%Exclusive%") & F.col("waiting_mode").like("%Share%")), """
    select h.relation, h.mode, n_held, w.mode as waiting_mode, n_waiting from (select relation, mode, count(*) as n_held from $locks where granted group by 1, 2) h
    join (select relation, mode, count(*) as n_waiting from $locks where not granted group by 1, 2) w on w.relation = h.relation
    where h.mode like '%Exclusive%' and w.mode like '%Share%'""")
add("j10_next_event", lambda i: ordered.neighbour(
    i.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], int_div(epoch_us("ts"), US["day"]),
    {"next_ts": "ts", "next_type": "event_type"}, ahead=True).select("event_id", "next_ts", "next_type"), """
    select event_id, lead(ts) over w as next_ts, lead(event_type) over w as next_type from events window w as (partition by user_id order by ts, event_id)""")
add("j11_other_session", lambda i: i.locks.join(i.locks.groupBy("relation").agg(F.min("pid").alias("a"), F.max("pid").alias("b")).where("a <> b").select("relation"),
                                               "relation", "left_semi").select("relation", "pid", "mode", "granted"), """
    select relation, pid, mode, granted from $locks l where exists (select 1 from (select distinct relation, pid from $locks) k where k.relation = l.relation and k.pid <> l.pid)""")
add("j12_dimension_twice", lambda i: i.orders.join(i.customer, F.col("o_custkey") == F.col("c_custkey")).join(i.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(
    i.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n")).join(
    i.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("source")), "s_nationkey").join(
    i.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("target")), "c_nationkey").select("source", "target", "n"), """
    select a.n_name as source, b.n_name as target, count(*) as n from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey
    join supplier on l_suppkey = s_suppkey join nation a on a.n_nationkey = s_nationkey join nation b on b.n_nationkey = c_nationkey group by 1, 2""")
add("j13_semi", lambda i: i.querylog.join(i.alertlog.select("query"), "query", "left_semi").select("query", "database"),
    "select query, database from $querylog where query in (select query from $alertlog)")
add("j14_exists", lambda i: i["class"].where(F.exists("relacl", lambda a: a.like("%=%r%/%"))).select("cluster_id", "oid"),
    "select cluster_id, oid from $class where exists (select 1 from (select unnest(relacl) as a) where a like '%=%r%/%')")
add("j15_tolerance", lambda i: i.sessions.join(i.connlog.where("event = 'authenticated'").select(F.col("pid").alias("process"), "recordtime"), "process").where(
    boundary_diff("second", "starttime", "recordtime").between(0, 4)).select("process", "starttime", "recordtime"), """
    select process, starttime, recordtime from $sessions join $connlog on pid = process and event = 'authenticated'
    where epoch_us(recordtime) // 1000000 - epoch_us(starttime) // 1000000 between 0 and 4""")
add("j16_any_of_array", lambda i: i.groups.select("cluster_id", "groname", F.explode("grolist").alias("usesysid")).join(
    i.users.where("not usesuper"), ["cluster_id", "usesysid"]).select("groname", "usename"), """
    select groname, usename from (select cluster_id, groname, unnest(grolist) as uid from $groups) g join $users u on u.usesysid = g.uid and u.cluster_id = g.cluster_id where not usesuper""")
add("j17_broadcast", lambda i: i.queuelog.join(F.broadcast(i.classcfg.select("service_class", "name")), "service_class").groupBy("name").agg(F.count("*").alias("n")),
    "select name, count(*) as n from $queuelog join $classcfg using (service_class) group by 1")
add("j18_never_matched", lambda i: i.tableinfo.join(i.scanlog.select(F.col("tbl").alias("table_id")), "table_id", "left_anti").select("table_id", "table_name"),
    "select table_id, table_name from $tableinfo where table_id not in (select tbl from $scanlog)")

# ---- aggregates
add("a01_basic", lambda i: i.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
    F.count("*").alias("n"), F.count("l_tax").alias("n_tax"), F.sum("l_quantity").alias("qty"), F.min("l_shipdate").alias("first_ship"),
    F.max("l_extendedprice").alias("max_price"), rounded(F.avg("l_quantity"), 6).alias("avg_qty")), """
    select l_returnflag, l_linestatus, count(*) as n, count(l_tax) as n_tax, sum(l_quantity) as qty, min(l_shipdate) as first_ship, max(l_extendedprice) as max_price,
           round(avg(l_quantity), 6) as avg_qty from lineitem group by 1, 2""")
add("a02_count_distinct", lambda i: i.scanlog.groupBy("tbl").agg(F.count_distinct("query", "segment").alias("n_segments"), F.count_distinct("query").alias("n_queries")), """
    select tbl, count(distinct (query, segment)) as n_segments, count(distinct query) as n_queries from $scanlog group by 1""")
add("a03_conditional", lambda i: i.scanlog.groupBy("slice").agg(
    total_if(F.col("is_rrscan") == "t").alias("n_rr"), F.count_if(F.col("type") == 2).alias("n_perm"), F.min(F.when(F.col("type") == 2, F.col("rows"))).alias("min_rows"),
    rounded(F.avg(F.when(F.col("is_rrscan") == "f", F.col("rows"))), 6).alias("avg_rows")), """
    select slice, count(*) filter (where is_rrscan = 't') as n_rr, count(*) filter (where type = 2) as n_perm, min(case when type = 2 then rows end) as min_rows,
           round(avg(case when is_rrscan = 'f' then rows end), 6) as avg_rows from $scanlog group by 1""")
add("a04_two_level", lambda i: i.blocks.groupBy("tbl", "slice").agg(F.count("*").alias("n")).groupBy("tbl").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("total")), """
    select tbl, min(n) as lo, max(n) as hi, cast(sum(n) as bigint) as total from (select tbl, slice, count(*) as n from $blocks group by 1, 2) group by 1""")
add("a05_guarded_ratio", lambda i: i.steplog.groupBy("segment").agg(percent(F.sum("rows"), F.sum("rows_pre_filter")).alias("pct")),
    "select segment, round(sum(rows)::double / nullif(sum(rows_pre_filter), 0)::double * 100, 4) as pct from $steplog group by 1")
add("a06_exact_quantiles", lambda i: ordered.exact_quantiles(i.lineitem.select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", {
    "p25": 0.25, "median": 0.5, "p99": 0.99}).select("l_returnflag", *[rounded(c, 4).alias(c) for c in ("p25", "median", "p99")]), """
    select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) as p25, round(median(l_extendedprice), 4) as median,
           round(quantile_cont(l_extendedprice, 0.99), 4) as p99 from lineitem group by 1""")
add("a06_quantiles_few_groups", lambda i: ordered.exact_quantiles_few_groups(i.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).select(
    "event_type", rounded("p50", 4).alias("p50"), rounded("p95", 4).alias("p95")), """
    select event_type, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95 from events group by 1""")
add("a07_stddev_of_buckets", lambda i: i.events.groupBy(hour_of("ts").alias("h"), "event_type").agg(F.count("*").alias("n")).groupBy("event_type").agg(
    rounded(F.avg("n"), 6).alias("mean"), rounded(F.stddev_samp("n"), 6).alias("sd")), """
    select event_type, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as sd from (select date_trunc('hour', ts) as h, event_type, count(*) as n from events group by 1, 2) group by 1""")
add("a08_listagg", lambda i: i.attrs.groupBy("cluster_id", "attrelid").agg(
    F.expr("listagg(attname, ',') within group (order by attnum)").alias("columns")), """
    select cluster_id, attrelid, string_agg(attname, ',' order by attnum) as columns from $attrs group by 1, 2""")


def _ranked_cells(i):
    cells = i.lineitem.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    return ordered.running_total(cells, ["l_returnflag"], ["l_quantity"], ordered.magnitude_bucket(F.col("l_quantity")), {"upto": "n"}, {"total": "n"})


def _band(first, last):
    return rounded(ordered.band_mean(*[F.col(c) for c in ("l_quantity", "n", "upto", "total")], first, last, 20), 6)


_NTILE = "select *, ntile(20) over (partition by l_returnflag order by l_quantity) as tile from lineitem"
add("a09_banded_mean", lambda i: _ranked_cells(i).groupBy("l_returnflag").agg(_band(6, 15).alias("central"), _band(20, 20).alias("top")), f"""
    select l_returnflag, round(avg(case when tile between 6 and 15 then l_quantity end), 6) as central, round(avg(case when tile = 20 then l_quantity end), 6) as top
    from ({_NTILE}) group by 1""")
add("a10_having", lambda i: i.scanlog.groupBy("tbl").agg(F.count("*").alias("n")).where("n > 95"), "select tbl, count(*) as n from $scanlog group by 1 having count(*) > 95")
add("a11_global", lambda i: i.partitions.agg(F.sum("used").alias("used"), F.sum("capacity").alias("capacity")),
    "select cast(sum(used) as bigint) as used, cast(sum(capacity) as bigint) as capacity from $partitions")
add("a12_bit_or", lambda i: i.alertlog.groupBy("slice").agg(F.bit_or(alert_bit("event")).alias("mask")),
    "select slice, cast(bit_or(case l_linenumber when 7 then 0 else 1 << (l_linenumber - 1) end) as bigint) as mask from (select l_suppkey % 16 as slice, l_linenumber from lineitem where l_discount >= 0.08) group by 1")
add("a13_group_as_distinct", lambda i: i.deletelog.groupBy("query", "tbl").agg(F.lit("W").alias("operation")), "select query, tbl, 'W' as operation from $deletelog group by 1, 2")
add("a14_latest_and_sample", lambda i: i.scanlog.groupBy("tbl").agg(F.max("starttime").alias("latest"), F.max("query").alias("sample"),
    F.max_by("query", F.struct("starttime", "query")).alias("latest_query")), """
    select tbl, max(starttime) as latest, max(query) as sample, arg_max(query, (starttime, query)) as latest_query from $scanlog group by 1""")
add("a15_unpivot", lambda i: i.metrics.unpivot(["service_class"], ["cpu_skew", "io_skew", "return_row_count"], "metric", "value").groupBy("service_class", "metric").agg(
    F.sum("value").alias("total"), F.max("value").alias("largest")), " union all ".join(
    f"select service_class, '{m}' as metric, cast(sum({m}) as bigint) as total, max({m}) as largest from $metrics group by 1" for m in ("cpu_skew", "io_skew", "return_row_count")))

# ---- windows
add("w01_partition_totals", lambda i: i.tableperm.select("id", "slice", "rows", F.sum("rows").over(W.partitionBy("id")).alias("total"), F.max("rows").over(W.partitionBy("id")).alias("hi")), """
    select id, slice, rows, cast(sum(rows) over (partition by id) as bigint) as total, max(rows) over (partition by id) as hi from $tableperm""")
add("w02_row_number", lambda i: i.tableperm.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("rows"), "slice"))).where("place <= 3").select("id", "slice", "place"), """
    select id, slice, row_number() over (partition by id order by rows desc, slice) as place from $tableperm qualify place <= 3""")
add("w03_series", lambda i: i.orders.agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi")).select(
    F.explode(F.sequence(F.col("lo").cast("date"), F.col("hi").cast("date"))).alias("day")).join(
    i.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n")), """
    select cast(d as date) as day, coalesce(n, 0) as n from (select unnest(generate_series(min(o_orderdate), max(o_orderdate), interval 1 day)) as d from orders)
    left join (select o_orderdate, count(*) as n from orders group by 1) on o_orderdate = d""")

add("w04_ntile", lambda i: _ranked_cells(i).groupBy("l_returnflag").agg(*[_band(t, t).alias(f"tile_{t}") for t in (1, 5, 10, 20)]), f"""
    select l_returnflag, {', '.join(f'round(avg(case when tile = {t} then l_quantity end), 6) as tile_{t}' for t in (1, 5, 10, 20))} from ({_NTILE}) group by 1""")
add("w05_lag_gap", lambda i: ordered.neighbour(i.events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], int_div(epoch_us("ts"), US["day"]),
    {"prev_ts": "ts"}).select("event_id", boundary_diff("second", "prev_ts", "ts").alias("gap_s")), """
    select event_id, epoch_us(ts) // 1000000 - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) // 1000000 as gap_s from events""")

# ---- sort, limit, top-k
add("o01_mixed_directions", lambda i: top(i.commitlog.select("xid", "queuelen", "startwork"), 50, F.desc("queuelen"), F.asc("startwork"), F.asc("xid")),
    "select xid, queuelen, startwork from $commitlog order by queuelen desc, startwork, xid limit 50")
add("o02_nulls_last", lambda i: top(i.cachelog.select("query", "source_query"), 6000, F.desc_nulls_last("source_query"), "query"),
    "select query, source_query from $cachelog order by source_query desc nulls last, query limit 6000")
add("o03_sort_by_expression", lambda i: top(i.orders.select("o_orderkey", "o_totalprice"), 25, F.abs(F.col("o_totalprice") - 250000), "o_orderkey"),
    "select o_orderkey, o_totalprice from orders order by abs(o_totalprice - 250000), o_orderkey limit 25")
add("o04_top_n", lambda i: top(i.querylog.select("query", boundary_diff("second", "starttime", "endtime").alias("secs")), 20, F.desc("secs"), "query"),
    "select query, epoch_us(endtime) // 1000000 - epoch_us(starttime) // 1000000 as secs from $querylog order by secs desc, query limit 20")
add("o05_bare_limit", lambda i: i.querylog.limit(5).agg(F.count("*").alias("n")), "select count(*) as n from (select * from $querylog limit 5)")

# ---- set operations
add("u01_union_all_padded", lambda i: i.queuelog.select("query", "service_class", F.col("total_exec_time").alias("us")).unionByName(
    i.cachelog.select("query", F.col("elapsed").alias("us")), allowMissingColumns=True), """
    select query, service_class, total_exec_time as us from $queuelog union all select query, null, elapsed from $cachelog""")
add("u02_union_distinct", lambda i: i.deletelog.select("query", "tbl").union(i.insertlog.select("query", "tbl")).distinct(),
    "select query, tbl from $deletelog union select query, tbl from $insertlog")
add("u03_tagged_union", lambda i: i.scanlog.select("tbl", F.lit("R").alias("tag")).unionByName(i.insertlog.select("tbl", F.lit("W").alias("tag"))).groupBy("tbl", "tag").agg(
    F.count("*").alias("n")), "select tbl, tag, count(*) as n from (select tbl, 'R' as tag from $scanlog union all select tbl, 'W' from $insertlog) group by 1, 2")

# ---- scalar functions
add("f01_strings", lambda i: i.customer.select(
    "c_custkey", F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("trimmed"), F.rtrim(F.concat("c_name", F.lit("  "))).alias("rtrimmed"), F.substring("c_name", 3, 4).alias("sub"),
    F.left("c_name", F.lit(5)).alias("lft"), F.length("c_name").alias("len"), F.upper("c_mktsegment").alias("up"), F.lower("c_mktsegment").alias("low"),
    F.lpad(F.col("c_custkey").cast("string"), 3, "0").alias("padded"), F.reverse("c_name").alias("rev"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("rep"),
    F.translate("c_name", "C#", "K_").alias("tra"), F.char(F.col("c_custkey") % 26 + 65).alias("letter")), """
    select c_custkey, trim('  ' || c_name || ' ') as trimmed, rtrim(c_name || '  ') as rtrimmed, substring(c_name, 3, 4) as sub, left(c_name, 5) as lft,
           cast(length(c_name) as int) as len, upper(c_mktsegment) as up, lower(c_mktsegment) as low, lpad(cast(c_custkey as varchar), 3, '0') as padded, reverse(c_name) as rev,
           replace(c_name, '#', '-') as rep, translate(c_name, 'C#', 'K_') as tra, chr(cast(c_custkey % 26 + 65 as int)) as letter from customer""")
add("f02_split_part", lambda i: i.alertlog.select("query", F.trim(F.split_part("event", F.lit(":"), F.lit(1))).alias("kind"), F.split_part("event", F.lit(":"), F.lit(2)).alias("detail")),
    "select query, trim(split_part(event, ':', 1)) as kind, split_part(event, ':', 2) as detail from $alertlog")
add("f03_position", lambda i: i.querylog.select("query", F.instr(F.upper("querytxt"), "SELECT").alias("at")), "select query, cast(strpos(upper(querytxt), 'SELECT') as int) as at from $querylog")
add("f04_regexp", lambda i: i.querylog.select(
    "query", F.col("querytxt").rlike("[sS]elect ").alias("hit"), F.regexp_substr("querytxt", F.lit("[0-9]-[A-Z]+")).alias("found"),
    F.regexp_replace("querytxt", "[0-9]+", "?").alias("masked"), leading_word("querytxt").alias("word")), """
    select query, regexp_matches(querytxt, '[sS]elect ') as hit, nullif(regexp_extract(querytxt, '[0-9]-[A-Z]+'), '') as found, regexp_replace(querytxt, '[0-9]+', '?', 'g') as masked,
           upper(nullif(regexp_extract(querytxt, '^\\s*([A-Za-z]+)', 1), '')) as word from $querylog""")
add("f05_concat_quote", lambda i: i.attrs.select("attrelid", "attnum", F.concat(F.lit("t."), quote_ident("attname")).alias("name")), """
    select attrelid, attnum, 't.' || case when regexp_full_match(attname, '[a-z_][a-z0-9_]*') then attname else '"' || replace(attname, '"', '""') || '"' end as name from $attrs""")
add("f06_md5", lambda i: i.documents.select("doc_id", F.md5("text").alias("fingerprint")), "select doc_id, md5(text) as fingerprint from documents")
add("f07_null_handling", lambda i: i.metrics.select(
    "query", F.coalesce("query_temp_blocks_to_disk", F.lit(-1)).alias("spill"), F.nullif(F.col("io_skew"), F.lit(0)).alias("skew"),
    F.greatest("cpu_skew", "io_skew").alias("worst")), """
    select query, coalesce(query_temp_blocks_to_disk, -1) as spill, nullif(io_skew, 0) as skew, greatest(cpu_skew, io_skew) as worst from $metrics""")
add("f08_numeric", lambda i: i.events.select(
    "event_id", rounded("value", 1).alias("r"), F.abs(F.col("user_id") - 75).alias("a"), F.ceil("value").alias("c"), F.pow(F.lit(2.0), F.col("event_id") % 10).alias("p"),
    (F.col("event_id") % 7).alias("m")), """
    select event_id, round(value, 1) as r, abs(user_id - 75) as a, cast(ceil(value) as bigint) as c, pow(2.0, event_id % 10) as p, event_id % 7 as m from events""")
add("f09_casts", lambda i: i.orders.select(
    "o_orderkey", F.floor("o_totalprice").cast("int").alias("whole"), F.col("o_orderkey").cast("double").alias("dbl"), F.col("o_orderdate").cast("date").alias("d"),
    F.col("o_orderkey").cast("string").alias("s"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p"), F.col("o_orderpriority").try_cast("int").alias("bad")), """
    select o_orderkey, cast(floor(o_totalprice) as int) as whole, cast(o_orderkey as double) as dbl, cast(o_orderdate as date) as d, cast(o_orderkey as varchar) as s,
           cast(substring(o_orderpriority, 1, 1) as int) as p, try_cast(o_orderpriority as int) as bad from orders""")
_UNITS = ("microsecond", "millisecond", "second", "minute", "hour", "day", "week")
add("f10_boundary_diff", lambda i: i.queuelog.select("query", *[boundary_diff(u, "queue_start_time", "exec_end_time").alias(u) for u in _UNITS]), f"""
    select query, {', '.join(f"(epoch_us(exec_end_time) + {s}) // {US[u]} - (epoch_us(queue_start_time) + {s}) // {US[u]} as {u}" for u in _UNITS for s in [259200000000 if u == 'week' else 0])}
    from $queuelog""")
add("f11_date_arithmetic", lambda i: i.orders.select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 2 days")).alias("later"),
    (F.col("o_orderdate") - F.expr("interval 90 minutes")).alias("earlier"), F.date_add(F.col("o_orderdate").cast("date"), 10).alias("d10")), """
    select o_orderkey, o_orderdate + interval 2 day as later, o_orderdate - interval 90 minute as earlier, cast(cast(o_orderdate as date) + 10 as date) as d10 from orders""")
add("f12_date_parts", lambda i: i.events.select("event_id", hour_of("ts").alias("h"), F.col("ts").cast("date").alias("d"), F.dayofmonth("ts").alias("dom"),
    (F.dayofweek("ts") - 1).alias("dow"), F.hour("ts").alias("hr"), int_div(epoch_us("ts"), 1000000).alias("epoch_s")), """
    select event_id, date_trunc('hour', ts) as h, cast(ts as date) as d, cast(day(ts) as int) as dom, cast(dayofweek(ts) as int) as dow, cast(hour(ts) as int) as hr,
           epoch_us(ts) // 1000000 as epoch_s from events""")
add("f13_labels", lambda i: i.events.select("event_id", F.date_format("ts", "yyyy-MM-dd-HH").alias("by_hour"), F.date_format("ts", "dd-MM-yyyy HH").alias("label")),
    "select event_id, strftime(ts, '%Y-%m-%d-%H') as by_hour, strftime(ts, '%d-%m-%Y %H') as label from events")
add("f14_human_duration", lambda i: i.queuelog.select("query", human_duration(int_div("total_exec_time", 1000) + 0).alias("text")), """
    select query, (total_exec_time // 1000) // 86400 || ' days ' || (total_exec_time // 1000) % 86400 // 3600 || 'hrs ' || (total_exec_time // 1000) % 3600 // 60 || 'mins '
           || (total_exec_time // 1000) % 60 || 'secs' as text from $queuelog""")
add("f15_bit_test", lambda i: i.events.select("event_id", (F.col("event_id").bitwiseAND(4) == 4).alias("has4"), F.col("event_id").bitwiseAND(7).alias("low3")),
    "select event_id, (event_id & 4) = 4 as has4, event_id & 7 as low3 from events")
add("f16_arrays", lambda i: i.groups.select("groname", "cluster_id", F.element_at("grolist", 1).alias("first"), F.array_contains("grolist", F.col("grosysid") * 50 + F.col("cluster_id")).alias("has"),
    F.array_join(F.transform("grolist", lambda x: x.cast("string")), "|").alias("text"), F.posexplode("grolist").alias("pos", "member")), """
    select groname, cluster_id, grolist[1] as first, list_contains(grolist, grosysid * 50 + cluster_id) as has, array_to_string(grolist, '|') as text,
           cast(unnest(range(0, len(grolist))) as int) as pos, unnest(grolist) as member from $groups""")
add("f17_names", lambda i: i.orders.select("o_orderkey", F.date_format("o_orderdate", "EEEE").alias("day_name"), F.date_format("o_orderdate", "MMMM").alias("month_name")),
    "select o_orderkey, dayname(o_orderdate) as day_name, monthname(o_orderdate) as month_name from orders")
add("f18_json", lambda i: i.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")),
    "select event_id, cast(regexp_extract(props, '(\\d+)', 1) as int) as k from events")

add("f20_type_width", lambda i: layout.column_width_estimate(i.attrs.select("format_type").distinct()), """
    select distinct format_type, cast(case when format_type = 'bigint' then 8 when format_type like 'numeric%' or format_type like 'character varying%'
           then cast(regexp_extract(format_type, '\\((\\d+)', 1) as bigint) else 0 end as bigint) as bytes from $attrs""")

# ---- user functions and dimensions
_OBSERVED = """select case dayofweek(d) when 6 then d - 1 when 0 then d + 1 else d end as h from (
        select cast(make_date(y, m, n) as date) as d, first, y from (select unnest(range(1994, 2003)) as y) cross join (values (1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)) t(m, n, first))
        where y >= first
    union all select cast(d + cast((w - dayofweek(d) + 7) % 7 + 7 * (n - 1) as int) as date) from (
        select make_date(y, m, 1) as d, w, n from (select unnest(range(1994, 2003)) as y) cross join (values (1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) t(m, w, n))
    union all select cast(d - cast((dayofweek(d) - 1 + 7) % 7 as int) as date) from (select make_date(y, 5, 31) as d from (select unnest(range(1994, 2003)) as y))"""
add("x01_holiday", lambda i: dims.calendar_columns(i.orders.select(F.col("o_orderdate").cast("date").alias("date")).distinct()).select("date", "holiday_flag"),
    f"select distinct cast(o_orderdate as date) as date, cast(o_orderdate as date) in (select cast(h as date) from ({_OBSERVED})) as holiday_flag from orders")
add("x02_week_starting_sunday", lambda i: i.events.select("event_id", week_starting_sunday("ts").alias("week")),
    "select event_id, strftime(cast(ts as date) - cast(dayofweek(ts) as int), '%Y-%m-%d') as week from events")
_HOST = "select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host from pages"
add("x03_host_name", lambda i: i.pages.select("page_id", host_name("url").alias("host")), _HOST)


def _registered(i):
    register_scalar(i.spark, "fleetgauge_url_host", url_host_function(), "string")
    return i.spark.sql("select page_id, fleetgauge_url_host(url) as host from {pages}", pages=i.pages)


add("x04_registered_function", _registered, _HOST)
add("m01_calendar_dim", lambda i: dims.calendar_of(i.orders, "o_orderdate").join(
    i.orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("n_orders")), "date", "left"), f"""
    with days as (select cast(d as date) as date from (select unnest(generate_series(min(o_orderdate), max(o_orderdate), interval 1 day)) as d from orders))
    select cast(strftime(date, '%Y%m%d') as int) as id, days.date, cast(year(date) as smallint) as year, cast(month(date) as smallint) as month, cast(day(date) as smallint) as day,
           cast(quarter(date) as smallint) as quarter, cast(weekofyear(date) as smallint) as week, dayname(date) as day_name, monthname(date) as month_name,
           date in (select cast(h as date) from ({_OBSERVED})) as holiday_flag, dayofweek(date) in (0, 6) as weekend_flag, n_orders
    from days left join (select cast(o_orderdate as date) as od, count(*) as n_orders from orders group by 1) on od = date""")
add("m02_date_span", lambda i: dims.date_span(i.orders, "o_orderdate"), """
    select min(o_orderdate) as first, max(o_orderdate) as last, epoch_us(max(o_orderdate)) // 86400000000 - epoch_us(min(o_orderdate)) // 86400000000 as days,
           (epoch_us(max(o_orderdate)) + 259200000000) // 604800000000 - (epoch_us(min(o_orderdate)) + 259200000000) // 604800000000 as weeks,
           cast(cast(max(o_orderdate) as date) + cast(epoch_us(max(o_orderdate)) // 86400000000 - epoch_us(min(o_orderdate)) // 86400000000 as int) as date) as shifted from orders""")
add("m03_outer_join_semantics", lambda i: dims.outer_join_on(
    i.customer.select(F.col("c_custkey").alias("id"), "c_mktsegment"), i.supplier.select(F.col("s_suppkey").alias("id"), "s_nationkey"), ["id"],
    left_only=F.col("c_mktsegment") == "MACHINERY"), """
    select c_custkey as id, c_mktsegment, s_nationkey from customer left join supplier on s_suppkey = c_custkey and c_mktsegment = 'MACHINERY'""")
add("m04_append_group_sums", lambda i: dims.append_group_sums(i.blocks, "tbl", "num_values"),
    "select tbl, num_values from $blocks union all select tbl, cast(sum(num_values) as bigint) from $blocks group by 1")
add("snapshot_newest_row", lambda i: newest(i.txns.select("pid", "xid", "txn_start"), ["pid"], "txn_start"),
    "select pid, xid, txn_start from $txns qualify row_number() over (partition by pid order by txn_start desc) = 1")
