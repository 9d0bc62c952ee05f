"""Load, storage-layout and maintenance reports on the bound logs."""

from pyspark.sql import functions as F

from ..operators import layout as op, loads
from .registry import add

AS_OF = "2002-01-01 00:00:00"
YEARS = 3650

# ---- loads
_LOAD = """
    with s as (select query, count(*) as n_files, cast(sum(transfer_size // 1048576) as bigint) as size_mb, (max(end_time) - min(start_time)) // 1000000 as seconds
               from $filelog where http_method = 'GET' and query > 0 and transfer_time > 0 group by 1)
    select q.starttime, s.query, q.querytxt, n_files, size_mb, seconds, size_mb // case seconds when 0 then 1 else seconds end as mb_per_s
    from s left join $querylog q on q.query = s.query"""
add("l01_load_performance", lambda i: loads.load_performance(i.filelog, i.querylog, as_of=AS_OF, lookback=YEARS), _LOAD)
add("l01_slowest_loads", lambda i: loads.load_performance(i.filelog, i.querylog, as_of=AS_OF, lookback=YEARS, limit=50),
    _LOAD + " order by seconds desc, size_mb desc, query limit 50")
_BYNODE = """select s.node, round(sum(data_size) / 1048576.0, 2) as raw_mb, round(sum(transfer_size) / 1048576.0, 2) as transferred_mb,
        round((sum(transfer_size) / 1048576.0) / (avg(transfer_time) / 1000000.0), 2) as mb_per_s, round(avg(transfer_time) / 60000000.0, 4) as transfer_min,
        round(avg(compression_time) / 60000000.0, 4) as compression_min, round(avg(app_connect_time) / 60000000.0, 4) as app_connect_min,
        round(avg(connect_time) / 60000000.0, 4) as connect_min, cast(sum(retries) as bigint) as retries
    from $filelog f join $slices s on s.slice = f.slice group by 1"""
add("l02_load_by_node", lambda i: loads.load_by_node(i.filelog, i.slices), _BYNODE)
add("l03_transfer_histogram", lambda i: loads.transfer_histogram(i.filelog), """
    select case when m < 2 then '0_1' when m < 6 then '2_5' else '6_plus' end as minutes, count(*) as n
    from (select transfer_time / 60000000.0 as m from $filelog) group by 1""")
add("l03_node_transfer_histogram", lambda i: loads.node_transfer_histogram(i.filelog, i.slices), f"""
    select case when transfer_min < 2 then '0_1' when transfer_min < 4 then '2_3' when transfer_min < 5 then '4_4' when transfer_min < 7 then '5_6'
                when transfer_min < 9 then '7_8' when transfer_min < 11 then '9_10' else '11_plus' end as minutes, count(*) as n
    from ({_BYNODE}) group by 1""")
add("l04_file_gap_by_node", lambda i: loads.file_gap_by_node(i.loadcommits, i.slices, as_of=AS_OF, lookback=YEARS), """
    with g as (select slice, epoch_us(curtime) // 1000000 - epoch_us(lag(curtime) over (partition by query order by curtime, filename, slice)) // 1000000 as gap
               from $loadcommits)
    select s.node, max(gap) as max_gap_s, count(*) as files from g join $slices s on s.slice = g.slice group by 1""")
add("l05_load_status", lambda i: loads.load_status(i.loadstate), "select * from $loadstate")
add("l06_load_errors", lambda i: loads.load_errors(i.loaderrors, i["class"]), """
    select distinct trim(c.relname) as table_name, query, trim(filename) as filename, line_number, trim(colname) as colname,
           trim(raw_field_value) as raw_field_value, trim(err_reason) as err_reason from $loaderrors e join $class c on c.oid = e.tbl""")
add("l07_last_load_errors", lambda i: loads.last_load_errors(i.loaderrors), """
    select query, starttime, filename, line_number, err_reason, colname, type as column_type, col_length, raw_field_value
    from $loaderrors where query = (select max(query) from $loaderrors)""")
add("l08_export_layout", lambda i: loads.export_layout(i.blocks, i.tableinfo), """
    select b.tbl, t.table_name, b.slice, count(*) as blocks, cast(sum(num_values) as bigint) as "values", t.size
    from $blocks b join $tableinfo t on t.table_id = b.tbl group by b.tbl, t.table_name, b.slice, t.size""")
add("l08_layout_profile", lambda i: loads.layout_profile(i.lineitem, F.col("l_suppkey") % 16, name="slice"), """
    with per as (select l_suppkey % 16 as slice, count(*) as rows from lineitem group by 1)
    select slice, rows, round(rows * 100.0 / (select sum(rows) from per), 4) as pct,
           round((select max(rows) from per) / (select min(rows) from per), 4) as skew from per""")
add("l08_file_sizes", lambda i: loads.file_sizes(i.lineitem))

# ---- layout
_TP = """(select db_id, id, name, cast(sum(rows) as bigint) as rows, max(rows) as rows_all, cast(sum(rows) - sum(sorted_rows) as bigint) as unsorted,
          max(rows) - max(sorted_rows) as unsorted_all from $tableperm group by 1, 2, 3)"""
_DET = """(select attrelid, min(attname) filter (where attisdistkey) as distkey, min(attname) filter (where attsortkeyord = 1) as head_sort,
          max(attsortkeyord) as n_sort, bool_or(attencodingtype <> 0) as encodes, round(count_if(attencodingtype <> 0) * 100.0 / count(attencodingtype), 4) as pct_encoded
          from $attrs group by attrelid)"""
_UNSORTED = """case when det.n_sort <> 0 then case when (case when c.reldiststyle = 8 then a.rows_all else a.rows end) = 0 then 0.0
     else round((case when c.reldiststyle = 8 then a.unsorted_all else a.unsorted end) * 100.0 / (case when c.reldiststyle = 8 then a.rows_all else a.rows end), 2) end end"""
add("d01_slice_distribution", lambda i: op.slice_distribution(i.tableperm, i["class"], i.ns, i.tableinfo), """
    select p.slice, n.oid as schema_oid, n.nspname as schema_name, p.id as table_id, p.name as table_name, t.diststyle, t.sortkey1 as sortkey,
           p.rows as rows_on_slice, cast(sum(p.rows) over w as bigint) as total_rows,
           case when p.rows = 0 then 0.0 else round(p.rows::double / (sum(p.rows) over w)::double * 100, 3) end as pct,
           case when p.rows = 0 then 0.0 else round((min(p.rows) over w)::double / (sum(p.rows) over w)::double * 100, 3) end as min_pct,
           case when p.rows = 0 then 0.0 else round((max(p.rows) over w)::double / (sum(p.rows) over w)::double * 100, 3) end as max_pct
    from $tableperm p join $class c on c.oid = p.id join $ns n on n.oid = c.relnamespace and n.cluster_id = c.cluster_id
         join $tableinfo t on t.table_id = p.id where c.relowner > 1 window w as (partition by p.id)""")
add("d02_table_info", lambda i: op.table_info(i.tableperm, i["class"], i.ns, i.blocks, i.attrs, i.partitions), f"""
    select trim(n.nspname) as schema_name, trim(a.name) as table_name, a.id as table_id,
           case c.reldiststyle when 0 then 'EVEN' when 1 then det.distkey when 8 then 'ALL' end as dist_key,
           case when c.reldiststyle <> 8 then r.skew end as skew, det.head_sort as sort_key, det.n_sort as n_sortkeys,
           case when c.reldiststyle = 8 then a.rows_all else a.rows end as rows, b.mbytes, case when det.encodes then 'Y' else 'N' end as encoded,
           det.pct_encoded, round(b.mbytes * 100.0 / (select sum(capacity)::double from $partitions where part_begin = 0), 4) as pct_of_total,
           case when a.rows <> 0 then round(((case when c.reldiststyle = 8 then a.rows_all else a.rows end) - c.reltuples) * 100.0
                / (case when c.reldiststyle = 8 then a.rows_all else a.rows end), 2) end as pct_stats_off, {_UNSORTED} as pct_unsorted
    from {_TP} a join $class c on c.oid = a.id join $ns n on n.oid = c.relnamespace and n.cluster_id = c.cluster_id
         join (select tbl, count(*) as mbytes from $blocks group by 1) b on b.tbl = a.id join {_DET} det on det.attrelid = a.id
         join (select tbl, round(max(mb) / min(mb), 4) as skew from (select tbl, slice, count(*) as mb from $blocks group by 1, 2) group by 1) r on r.tbl = a.id
    where c.relowner > 1""")
add("d02_largest_tables", lambda i: op.largest_tables(i.tableperm, i["class"], i.ns, i.db, i.blocks, limit=100), f"""
    select d.datname as database, n.nspname as schema_name, a.name as table_name, b.mbytes, a.rows
    from {_TP} a join $class c on c.oid = a.id join $ns n on n.oid = c.relnamespace and n.cluster_id = c.cluster_id join $db d on d.oid = a.db_id
         join (select tbl, count(*) as mbytes from $blocks group by 1) b on b.tbl = a.id
    order by mbytes desc, database, schema_name, table_name limit 100""")
add("d03_table_inspector", lambda i: op.table_inspector(i.tableinfo, i.blocks, i.slices), """
    select schema_name, table_name, table_id, size as size_mb, case when diststyle not in ('EVEN', 'ALL') then 1 else 0 end as has_dist_key,
           case when sortkey1 is not null then 1 else 0 end as has_sort_key, case when encoded = 'Y' then 1 else 0 end as has_col_encoding,
           round(100.0 * (hi - lo) / greatest(lo, 1), 2) as pct_skew_across_slices,
           round(100.0 * n / (select count(distinct slice) from $slices), 2) as pct_slices_populated
    from $tableinfo t join (select tbl, min(c) as lo, max(c) as hi, count(*) as n from (select tbl, slice, count(*) as c from $blocks group by 1, 2) group by 1) q
         on q.tbl = t.table_id""")
add("d04_space_per_table", lambda i: op.space_per_table(i.tableperm, i["class"], i.ns, i.db, i.attrs, i.blocks), f"""
    select *, case when rowcount = 0 then 'n/a' when pct_unsorted >= 20 then 'VACUUM SORT recommended' else 'n/a' end as recommendation from (
        select d.datname as database, trim(n.nspname) as schema_name, trim(c.relname) as table_name, a.id as table_id, b.mbytes as megabytes,
               case when c.reldiststyle = 8 then a.rows_all else a.rows end as rowcount,
               case when c.reldiststyle = 8 then a.unsorted_all else a.unsorted end as unsorted_rowcount, {_UNSORTED} as pct_unsorted
        from {_TP} a join $class c on c.oid = a.id join $ns n on n.oid = c.relnamespace and n.cluster_id = c.cluster_id join $db d on d.oid = a.db_id
             join {_DET} det on det.attrelid = a.id left join (select tbl, count(*) as mbytes from $blocks group by 1) b on b.tbl = a.id
        where c.relowner > 1)""")
add("d04_space_per_slice", lambda i: op.space_per_slice(i.tableperm, i["class"], i.ns, i.db, i.blocks), f"""
    select b.slice, d.datname as database, n.nspname as schema_name, a.name as table_name, a.id as table_id, b.mbytes as megabytes, a.rows as rowcount,
           a.unsorted as unsorted_rowcount, case when a.rows = 0 then 0 else round(a.unsorted * 100.0 / a.rows, 5) end as pct_unsorted,
           case when a.rows <> 0 and a.unsorted * 100.0 / a.rows >= 20 then 'VACUUM recommended' else 'n/a' end as recommendation
    from {_TP} a join $class c on c.oid = a.id join $ns n on n.oid = c.relnamespace and n.cluster_id = c.cluster_id join $db d on d.oid = a.db_id
         left join (select tbl, slice, count(*) as mbytes from $blocks group by 1, 2) b on b.tbl = a.id""")
add("d05_extended_table_info",
    lambda i: op.extended_table_info(i.tableinfo, i["class"], i.scanlog, i.alertlog, i.planinfo, i.planlog, i.constraints, i.attrs, i.tableperm, i.slices,
                                     as_of=AS_OF, lookback=YEARS), """
    with ids as (select oid from $class where relowner > 1 and relkind = 'r'),
    mine as (select * from $scanlog semi join ids on tbl = ids.oid where userid > 1),
    said as (select distinct query, segment, step, split_part(event, ':', 1) as kind from $alertlog where userid > 1),
    scanned as (select distinct tbl, query, segment, step from mine),
    alerts as (select tbl, count_if(kind = 'Very selective query filter') as sel, count_if(kind = 'Scanned a large number of deleted rows') as dels
               from scanned join said using (query, segment, step) group by tbl),
    visits as (select tbl, max(endtime) as last_scan, count(distinct (query, segment)) as num_scans from mine group by tbl),
    plan as (select i.query, i.segment, i.step, count(*) as nodes, count_if(starts_with(p.info, 'Filter:') and p.nodeid > 0) as filters
             from $planinfo i join $planlog p using (userid, query, nodeid) group by all),
    reads as (select tbl, query, segment, step, max(is_rrscan = 't') as restricted from mine where type = 2 group by all),
    planned as (select tbl, cast(sum(case when restricted then nodes else 0 end) as bigint) as rr_scans, cast(sum(filters) as bigint) as filtered
                from reads join plan using (query, segment, step) group by tbl),
    keys as (select conrelid, case when bool_or(contype = 'p') then 'Y' end as pk, case when bool_or(contype = 'f') then 'Y' end as fk from $constraints semi join ids on conrelid = ids.oid group by conrelid),
    widths as (select attrelid, count_if(attencodingtype <> 0) as enc, count(*) as cols from $attrs semi join ids on attrelid = ids.oid where attnum > 0 group by attrelid),
    fill as (select id, sum(rows) as total, sum(sorted_rows) as in_order, count(distinct slice) as places from $tableperm semi join ids on id = ids.oid group by id)
    select t.database, t.table_id, schema_name || '.' || table_name as table_name, enc || '/' || cols as columns, pk, fk, max_varchar,
           case when diststyle in ('EVEN', 'ALL') then diststyle else diststyle || ': ' || skew_rows end as diststyle,
           sortkey1 || case when sortkey1_enc is null then '' else '(' || coalesce(skew_sortkey1, 0) || ')' end as sortkey,
           size || '/' || ((case when diststyle = 'ALL' then (select count(distinct node) from $slices) else places end)
               * (cols + 3) * (case when total = in_order or in_order = 0 then 1 else 2 end)) || ' (' || pct_used || ')' as size,
           tbl_rows, unsorted, stats_off,
           array_to_string([coalesce(num_scans, 0), coalesce(rr_scans, 0), coalesce(filtered, 0), coalesce(sel, 0), coalesce(dels, 0)], ':') as scan_counters, last_scan
    from $tableinfo t left join widths on attrelid = t.table_id left join fill on fill.id = t.table_id left join visits on visits.tbl = t.table_id
         left join planned on planned.tbl = t.table_id left join keys on conrelid = t.table_id left join alerts on alerts.tbl = t.table_id where schema_name <> 'pg_internal'""")
add("d06_minimum_table_size", lambda i: op.minimum_table_size(i.blocks, i["class"], i.slices), """
    select b.tbl as table_id, trim(relname) as table_name, case reldiststyle when 0 then 'even' when 1 then 'key' when 8 then 'all' end as diststyle, sl as slices,
           co as columns, sp as regions, nodes, case when reldiststyle in (0, 1) then sl * co * sp when reldiststyle = 8 then nodes * co * sp end as minimum_size, n as actual_size
    from (select tbl, count(distinct slice) as sl, count(distinct col) as co, count(distinct unsorted) as sp, count(*) as n from $blocks group by 1) b
         join $class c on c.oid = b.tbl cross join (select count(distinct node) as nodes from $slices)""")
add("d07_fragmentation", lambda i: op.fragmentation(i.blocks, i.slices, i.tableperm, i.db), """
    with cells as (select tbl, slice, col, count_if(num_values > 0) as live, count_if(num_values between 1 and 130993) as partly,
                          sum(case when num_values between 1 and 130993 then num_values end) as held from $blocks group by all),
    tails as (select tbl, slice, col, partly - ceil(held / 130994.0) as surplus from cells
              qualify col = max(col) over (partition by tbl, slice) and live > 0 and partly > 0),
    gains as (select tbl, node, sum(surplus * (col + 1)) as gain from tails join $slices using (slice) where surplus > 1 and tbl > 1
              group by tbl, col, node),
    named as (select id, max(trim(name)) as name, max(db_id) as db_id from $tableperm group by id)
    select p.id as tbl, p.name as table_name, trim(x.datname) as database, cast(sum(gain) as bigint) as est_space_gain
    from gains join named p on p.id = gains.tbl join $db x on x.oid = p.db_id group by all""")
_KIND = """case when tbl > 0 then 'User_Table' when tbl = 0 then 'Freed_Blocks' when tbl = -2 then 'Catalog_File_Store' when tbl = -3 then 'Metadata'
     when tbl = -4 then 'Temp_Delete_Blocks' when tbl = -6 then 'Query_Spill_To_Disk' else 'Stage_blocks_For_Real_Table_DML' end as block_type"""
add("d08_block_classes", lambda i: op.block_classes(i.rawblocks), f"""
    select {_KIND}, case when tombstone > 0 then 1 else 0 end as tombstone, count(*) as mbytes, count(*) // 1024 as gbytes from $rawblocks group by 1, 2""")
add("d08_block_classes_by_node", lambda i: op.block_classes(i.rawblocks, slices=i.slices), f"""
    select node, {_KIND}, case when tombstone > 0 then 1 else 0 end as tombstone, count(*) as mbytes, count(*) // 1024 as gbytes
    from $rawblocks b join $slices s on s.slice = b.slice group by 1, 2, 3""")
_PERTBL = f"""select tbl, {_KIND}, case when tombstone > 0 then 1 else 0 end as tombstone, count(*) as mbytes, count(*) // 1024 as gbytes from $rawblocks group by 1, 2, 3"""
add("d08_largest_block_owners", lambda i: op.block_classes(i.rawblocks, per_table=True, tableinfo=i.tableinfo, limit=10),
    f"select b.*, t.schema_name, t.table_name from ({_PERTBL}) b left join $tableinfo t on t.table_id = b.tbl order by mbytes desc, tbl, block_type, tombstone limit 10")
add("d08_block_owners_by_gb", lambda i: op.block_classes(i.rawblocks, per_table=True, tableinfo=i.tableinfo, min_gb=1),
    f"select b.*, t.schema_name, t.table_name from ({_PERTBL}) b left join $tableinfo t on t.table_id = b.tbl where gbytes > 0")
add("d09_skew_by_table", lambda i: op.skew_by_table(i.blocks), """
    select tbl, name, min(mb) as min_mb, max(mb) as max_mb, round(min(mb) / max(mb), 6) as evenness
    from (select tbl, name, slice, count(*) as mb from $blocks group by 1, 2, 3) group by 1, 2""")
add("d09_table_slice_detail", lambda i: op.table_slice_detail(i.blocks, i.slices), """
    select tbl, name, node, s.slice, count(*) as blocks_total, cast(sum(unsorted) as bigint) as blocks_unsorted, cast(sum(tombstone) as bigint) as blocks_deleted
    from $blocks b join $slices s on s.slice = b.slice group by 1, 2, 3, 4""")
for by in ((), ("owner",), ("owner", "host", "diskno")):
    cols = ", ".join(by) + ", " if by else ""
    add("d10_disk_capacity" + ("_by_" + by[-1] if by else ""), lambda i, b=by: op.disk_capacity(i.partitions, by=b), f"""
    select {cols}cast(sum(used) as bigint) as used_mb, cast(sum(capacity) as bigint) as capacity_mb, cast(sum(capacity) - sum(used) as bigint) as free_mb,
           round(sum(capacity) / 1024.0, 4) as capacity_gb, round(sum(used) / 1024.0, 4) as used_gb, round(sum(used - tossed)::double / sum(capacity)::double * 100, 4) as pct_used
    from $partitions where part_begin = 0 group by all""")
add("d11_column_block_cost", lambda i: op.column_block_cost(i.blocks, i.attrs, i["class"], i.ns), """
    select n.nspname as schema_name, c.relname as table_name, b.tbl as table_id, trim(a.attname) as column_name, a.attnum as column_id, count(*) as mbytes,
           cast(sum(num_values) as bigint) as n_values, round(count(*) * 1048576.0 / nullif(sum(num_values), 0), 2) as bytes_per_value
    from $blocks b join $class c on c.oid = b.tbl join $ns n on n.oid = c.relnamespace and n.cluster_id = c.cluster_id
         join $attrs a on a.attrelid = b.tbl and a.attnum = b.col and a.cluster_id = c.cluster_id group by 1, 2, 3, 4, 5""")
add("d12_column_width_estimate", lambda i: op.column_width_estimate(i.attrs.select("attrelid", "attname", "format_type")), """
    select attrelid, attname, format_type, cast(case when format_type = 'integer' then 4 when format_type = 'bigint' then 8 when format_type = 'smallint' then 2
           when format_type = 'timestamp without time zone' then 8 when format_type like 'numeric%' or format_type like 'character varying%'
           then cast(regexp_extract(format_type, '\\((\\d+)', 1) as bigint) else 0 end as bigint) as bytes from $attrs""")
_FREQ = """
    select database, schema_name, table_id, table_name, size, sortkey1, coalesce(s.n, 0) as num_qs
    from $tableinfo t left join (select tbl, count(distinct query) as n from $scanlog where userid > 1 and perm_table_name not in ('Internal Worktable', 'S3') group by 1) s
         on s.tbl = t.table_id where schema_name <> 'pg_internal'"""
add("d13_scan_frequency", lambda i: op.scan_frequency(i.tableinfo, i.scanlog), _FREQ)
add("d14_unscanned_summary", lambda i: op.unscanned_summary(i.tableinfo, i.scanlog, op.node_capacity_tb(i.slices, i.partitions)), f"""
    with a as (select count(*) as n, sum(round(size / 1048576.0, 2)) as sz, count(*) filter (where num_qs = 0) as un,
                      coalesce(sum(round(size / 1048576.0, 2)) filter (where num_qs = 0), 0) as us,
                      (select count(distinct node) from $slices) * (case when (select count(distinct slice) from $slices where node = 0) = 32 then 2.56
                           when (select count(distinct slice) from $slices where node = 0) = 16 then 16.0
                           when (select count(owner) from $partitions where owner = 0) > 2 then 2.0 else 0.16 end) as cap from ({_FREQ}))
    select n || ' total tables @ ' || cast(sz as decimal(20,2)) || 'TB / ' || cast(cap as decimal(20,2)) || 'TB (' || cast(round(100.0 * sz / cap, 1) as decimal(20,1)) || '%)' as all_tables,
           un || ' unscanned tables @ ' || cast(us as decimal(20,2)) || 'TB / ' || cast(cap as decimal(20,2)) || 'TB (' || cast(round(100.0 * us / cap, 1) as decimal(20,1)) || '%)' as unscanned_tables
    from a""")
_NEXT = """runs as (select *, lead(status) over w as s2, lead(rows) over w as r2, lead(sortedrows) over w as o2, lead(blocks) over w as b2, lead(eventtime) over w as t2
        from $vacuumlog window w as (partition by xid, table_id order by eventtime, status))"""
add("d15_maintenance_runs", lambda i: op.maintenance_runs(i.vacuumlog, i.tableperm, i["class"], i.ns), f"""
    with {_NEXT},
    named as (select p.id, any_value(p.name) as table_name, any_value(x.nspname) as schema_name from $tableperm p join $class k on k.oid = p.id
              join $ns x on x.oid = k.relnamespace and x.cluster_id = k.cluster_id group by p.id)
    select userid, xid, table_id, schema_name, table_name, status as start_status, rows as start_rows, blocks as start_blocks, eventtime as start_time, s2 as end_status, r2 as end_rows,
           b2 as end_blocks, t2 as end_time, rows - r2 as rows_deleted, blocks - b2 as blocks_deleted_added, epoch_us(t2) // 1000000 - epoch_us(eventtime) // 1000000 as seconds
    from runs join named on named.id = table_id where status <> 'Finished'""")
add("d16_maintenance_summary", lambda i: op.maintenance_summary(i.vacuumlog, i.tableperm, i.db, i.blocks, i.txns, as_of=AS_OF), f"""
    with {_NEXT},
    open as (select distinct xid as open_xid from $txns where lockable_object_type = 'transactionid'),
    hollow as (select tbl, count(*) as n from $blocks where num_values = 0 group by tbl)
    select userid, xid, g.datname as database, table_id, p.name as table_name, status as start_status,
           case when status like 'Skipped%' then null when open_xid is not null then 'Running' else coalesce(s2, 'Failed') end as end_status, eventtime as start_time, t2 as end_time,
           epoch_us(case when open_xid is not null then timestamp '2002-01-01' else t2 end) // 1000000 - epoch_us(eventtime) // 1000000 as seconds, rows as start_rows, r2 as end_rows,
           rows - r2 as deleted_rows, sortedrows as start_sorted_rows, o2 as end_sorted_rows, blocks as start_blocks, b2 as end_blocks, b2 - blocks as block_diff, coalesce(hollow.n, 0) as empty_blocks
    from runs r left join (select id, max(name) as name, max(db_id) as db_id from $tableperm group by id) p on p.id = r.table_id left join $db g on g.oid = p.db_id
         left join hollow on hollow.tbl = r.table_id left join open on open_xid = r.xid where status <> 'Finished'""")
add("d17_key_mismatch", lambda i: op.key_mismatch(i.insertlog, i.scanlog, i["class"], i.ns, i.attrs), """
    with names as (select c.oid, n.nspname || '.' || c.relname as full_name, k.distkey from $class c join $ns n on n.oid = c.relnamespace and n.cluster_id = c.cluster_id
                   left join (select attrelid, min(case when attisdistkey then attname end) as distkey from $attrs group by 1) k on k.attrelid = c.oid)
    select distinct t.full_name as target, t.distkey as target_key, s.full_name as source, s.distkey as source_key
    from $insertlog i join $scanlog x on x.query = i.query join names t on t.oid = i.tbl join names s on s.oid = x.tbl
    where i.tbl <> x.tbl and x.perm_table_name <> 'Internal Worktable' and (t.distkey <> s.distkey or t.distkey is null or s.distkey is null)""")
add("d18_table_row_slices", lambda i: op.table_row_slices(i.tableperm), "select * from $tableperm")
