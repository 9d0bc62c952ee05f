"""Log and catalog inputs derived from the given tables, one SELECT per input.

``$name`` refers to a given table or another binding. The same text, spelled for either engine,
feeds the Spark operators and the checking SQL, so both see identical inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .dialect import CheckSpelling, SparkSpelling

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
# declared column types: no schema inference job per read
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
#: Days of the catalog snapshots, by the letter that ends the binding's name.
DAYS = {"a": "2024-01-01", "b": "2024-01-02", "c": "2024-01-04", "d": "2024-01-05"}
_REF = re.compile(r"\$([a-z_]+)")


def definitions(d) -> dict[str, str]:
    b: dict[str, str] = {}

    # ---- queue family, one row per event
    queue_us = "case when event_id % 4 = 0 then 0 else (event_id * 7919 % 600) * 1000000 end"
    exec_us = "(1 + event_id * 104729 % 7200) * 1000000"
    b["queuelog"] = f"""
        select user_id + 1 as userid, event_id as xid, event_id as task, event_id as query,
               cast(5 + user_id % 4 as int) as service_class, cast(1 + event_id % 3 as int) as slot_count,
               ts as service_class_start_time, ts as queue_start_time,
               {d.plus_us('ts', queue_us)} as queue_end_time, {queue_us} as total_queue_time,
               {d.plus_us('ts', queue_us)} as exec_start_time,
               {d.plus_us('ts', f'{queue_us} + {exec_us}')} as exec_end_time, {exec_us} as total_exec_time,
               {d.plus_us('ts', f'{queue_us} + {exec_us}')} as service_class_end_time,
               case when event_type = 'error' then 'Evicted' else 'Completed' end as final_state
        from $events"""
    b["queue_querylog"] = f"""
        select user_id + 1 as userid, 'default' as label, event_id as xid, user_id as pid, event_id as query,
               event_type as database, event_type || ' ' || props as querytxt, ts as starttime,
               {d.plus_us('ts', f'{queue_us} + {exec_us}')} as endtime,
               case when event_type = 'error' then 1 else 0 end as aborted
        from $events"""
    b["classcfg"] = """
        select cast(service_class as int) as service_class, name, cast(num_query_tasks as int) as num_query_tasks,
               cast(query_working_mem as int) as query_working_mem, cast(max_execution_time as bigint) as max_execution_time,
               user_group_wild_card, query_group_wild_card
        from (values (5, 'super', 5, 100, 0, false, false), (6, 'etl', 20, 400, 3600, true, false),
                     (7, 'maintenance', 3, 250, 1800, false, true), (8, 'any', 15, 300, 900, false, false))
             as t(service_class, name, num_query_tasks, query_working_mem, max_execution_time,
                  user_group_wild_card, query_group_wild_card)"""
    b["rules"] = """
        select cast(action_service_class as int) as action_service_class, condition
        from (values (5, 'superuser'), (6, 'user group: etl'), (7, 'query group: maintenance'),
                     (7, 'query group: vacuum'), (8, 'any query')) as t(action_service_class, condition)"""
    b["class_state"] = """
        select cast(5 + user_id % 4 as int) as service_class,
               cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as num_queued_queries,
               cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) as num_executing_queries,
               count(*) as num_executed_queries
        from $events group by 1"""
    b["queue_state"] = f"""
        select event_id as xid, event_id as task, event_id as query, cast(5 + user_id % 4 as int) as service_class,
               cast(1 + event_id % 3 as int) as slot_count, ts as wlm_start_time,
               case event_type when 'view' then 'Running' when 'click' then 'QueuedWaiting'
                    when 'purchase' then 'Returning' else 'Evicted ' end as state,
               {queue_us} as queue_time, {exec_us} as exec_time
        from $events"""
    b["metrics"] = f"""
        select user_id + 1 as userid, cast(5 + user_id % 4 as int) as service_class, event_id as query,
               {d.whole('value * value * 10')} as query_cpu_time, {d.whole('value * value')} as query_blocks_read,
               {d.whole('value * 1000')} as query_execution_time, {d.whole('value / 5')} as query_cpu_usage_percent,
               case when event_id % 9 = 0 then {d.whole('value * 3')} end as query_temp_blocks_to_disk,
               {d.whole('value * 100')} as segment_execution_time, {d.whole('value / 7')} as cpu_skew,
               {d.whole('value / 10')} as io_skew, {d.whole('value * value * value')} as scan_row_count,
               {d.whole('value * value * 5')} as join_row_count,
               case when event_id % 13 = 0 then {d.whole('value * value')} end as nested_loop_join_row_count,
               event_id % 1000 as return_row_count, {d.whole('value')} as spectrum_scan_row_count,
               {d.whole('value / 3')} as spectrum_scan_size_mb
        from $events"""
    b["stepmetrics"] = f"""
        select event_id as query, cast(-1 as int) as segment, cast(-1 as int) as step, cast(0 as int) as step_type,
               cast(0 as bigint) as rows, {d.whole('value * 1000000')} as cpu_time,
               {d.whole('value * 2')} as blocks_read,
               case when event_type = 'error' then -1 else {d.whole('value')} end as blocks_to_disk
        from $events
        union all
        select event_id, cast(0 as int), cast(1 as int), cast(case when event_type = 'view' then 15 else 38 end as int),
               {d.whole('value * 7')}, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint)
        from $events"""
    b["cachelog"] = f"""
        select o_custkey % 50 + 1 as userid, o_orderkey as query, {d.plus_s('o_orderdate', 'o_orderkey % 86400')} as starttime,
               case when o_orderstatus = 'P' then 1 else 0 end as aborted, (o_orderkey * 31 % 900) * 1000000 as elapsed,
               case when o_orderstatus <> 'F' then {d.div('o_orderkey', '4')} end as source_query
        from $orders"""

    # ---- statements, one row per order
    b["querylog"] = f"""
        select o_custkey % 50 + 1 as userid, case when o_orderkey % 3 = 0 then 'etl' else 'default' end as label,
               {d.div('o_orderkey', '3')} as xid, o_custkey as pid, o_orderkey as query, o_orderstatus as database,
               case o_custkey % 12 when 0 then 'select * from facts ' when 1 then 'INSERT into facts '
                    when 2 then 'copy facts from bucket ' when 3 then 'Update facts set a = ' when 4 then 'delete from facts '
                    when 5 then 'fetch 100 from c1 ' when 6 then 'undoing transaction ' when 7 then 'close cursor c1 '
                    when 8 then 'vacuum facts ' when 9 then 'padb_fetch_sample: facts ' when 10 then 'Select count(*) from dim '
                    else '-- comment ' end || o_orderpriority as querytxt,
               {d.plus_s('o_orderdate', 'o_orderkey % 86400')} as starttime,
               {d.plus_us('o_orderdate', '(o_orderkey % 86400 + o_orderkey * 31 % 3600) * 1000000 + (o_orderkey * 977 % 1000) * 1000')} as endtime,
               case when o_orderstatus = 'P' then 1 else 0 end as aborted
        from $orders"""
    b["statementtext"] = """
        select userid, xid, pid, label, starttime, endtime, cast(0 as int) as sequence, 'QUERY' as type,
               querytxt as text, query from $querylog"""
    b["utilitytext"] = f"""
        select o_custkey % 50 + 1 as userid, o_orderkey as xid, o_custkey as pid, 'default' as label,
               {d.plus_s('o_orderdate', 'o_orderkey % 86400')} as starttime,
               {d.plus_s('o_orderdate', 'o_orderkey % 86400 + 1')} as endtime, cast(0 as int) as sequence,
               case o_orderpriority when '1-URGENT' then 'DECLARE c1 CURSOR FOR select * from '
                    when '2-HIGH' then 'commit;' when '3-MEDIUM' then 'ROLLBACK;'
                    when '4-NOT SPECIFIED' then 'begin;' else 'analyze facts;' end as text
        from $orders
        union all
        select o_custkey % 50 + 1, o_orderkey, o_custkey, 'default', {d.plus_s('o_orderdate', 'o_orderkey % 86400')},
               {d.plus_s('o_orderdate', 'o_orderkey % 86400 + 1')}, cast(1 as int), 'facts_' || cast(o_custkey as string)
        from $orders where o_orderpriority = '1-URGENT'"""
    if d.name == "spark":
        pieces = "explode(sequence(0, greatest(cast(ceil(length(text) / 200.0) as int) - 1, 0)))"
    else:
        pieces = "unnest(range(0, greatest(cast(ceil(length(text) / 200.0) as int), 1)))"
    b["querytext"] = f"""
        select query, cast(sequence as int) as sequence, substring(whole, cast(sequence as int) * 200 + 1, 200) as text
        from (select doc_id as query, text as whole, {pieces} as sequence from $documents) as t"""
    b["commitlog"] = f"""
        select o_orderkey as xid, cast(o_orderkey % 4 - 1 as int) as node,
               case when o_orderstatus = 'P' then {d.ntz('2000-01-01 00:00:00')}
                    else {d.plus_s('o_orderdate', 'o_orderkey % 86400')} end as startqueue,
               {d.plus_s('o_orderdate', 'o_orderkey % 86400 + o_orderkey % 50')} as startwork,
               {d.plus_s('o_orderdate', 'o_orderkey % 86400 + o_orderkey % 50 + o_orderkey % 7')} as endtime,
               cast(o_orderkey % 11 as int) as queuelen
        from $orders"""
    b["vacuumlog"] = f"""
        select o_custkey % 50 + 1 as userid, o_orderkey as xid, 1000 + o_custkey as table_id,
               case when o_orderpriority = '5-LOW' then 'Skipped(sorted>=95%)' else 'Started' end as status,
               {d.whole('o_totalprice')} as rows, {d.whole('o_totalprice / 2')} as sortedrows,
               o_custkey + 10 as blocks, {d.plus_s('o_orderdate', 'o_orderkey % 86400')} as eventtime
        from $orders
        union all
        select o_custkey % 50 + 1, o_orderkey, 1000 + o_custkey, 'Finished', {d.whole('o_totalprice * 0.75')},
               {d.whole('o_totalprice * 0.75')}, o_custkey + 7,
               {d.plus_s('o_orderdate', 'o_orderkey % 86400 + 1 + o_orderkey % 600')}
        from $orders where o_orderstatus <> 'P' and o_orderpriority <> '5-LOW'"""
    b["analyzelog"] = f"""
        select o_custkey % 50 + 1 as userid, o_orderkey as xid, 'dev' as database, 1000 + o_custkey as table_id,
               'Full' as status, {d.whole('o_totalprice')} as rows, {d.whole('o_totalprice / 10')} as modified_rows,
               cast(10 as int) as threshold_percent, {d.plus_s('o_orderdate', 'o_orderkey % 86400')} as starttime
        from $orders"""
    b["cursors"] = f"""
        select o_custkey % 50 + 1 as userid, o_orderkey as xid, o_custkey as pid,
               {d.plus_s('o_orderdate', 'o_orderkey % 86400')} as starttime, {d.whole('o_totalprice')} as row_count,
               {d.whole('o_totalprice * 300')} as byte_count, {d.whole('o_totalprice / 3')} as fetched_rows
        from $orders where o_orderpriority = '1-URGENT'"""
    b["conflictlog"] = f"""
        select {d.div('o_orderkey', '3')} as xact_id, o_custkey as process_id, o_orderdate as xact_start_ts,
               {d.plus_s('o_orderdate', 'o_orderkey % 3600')} as abort_time, 1000 + o_custkey as table_id
        from $orders where o_orderstatus = 'P'"""

    # ---- steps, one row per line item
    b["scanlog"] = f"""
        select l_orderkey % 50 + 1 as userid, l_orderkey as query, l_suppkey % 16 as slice, l_linenumber as segment,
               cast(l_linenumber % 3 as int) as step, 1000 + l_partkey - l_partkey % 3 as tbl,
               case when l_tax = 0.08 then 'Internal Worktable' else 'facts_' || cast(l_partkey - l_partkey % 3 as string) end as perm_table_name,
               cast(case when l_linestatus = 'F' then 2 else 1 end as int) as type, l_shipdate as starttime,
               {d.plus_s('l_shipdate', f"l_linenumber * {d.whole('l_quantity')} - 20")} as endtime,
               {d.whole('l_quantity')} as rows, {d.whole('l_extendedprice')} as bytes,
               case when l_returnflag = 'R' then 't' else 'f' end as is_rrscan
        from $lineitem"""
    b["distlog"] = f"""
        select l_orderkey as query, l_suppkey % 16 as slice, l_linenumber as segment, l_shipdate as starttime,
               {d.plus_s('l_shipdate', d.whole('l_quantity'))} as endtime, {d.whole('l_quantity * 2')} as rows,
               {d.whole('l_extendedprice')} as bytes, {d.div(d.whole('l_quantity'), '10')} as packets
        from $lineitem where l_returnflag = 'A'"""
    b["bcastlog"] = f"""
        select l_orderkey as query, l_suppkey % 16 as slice, cast(l_linenumber % 3 as int) as step, l_linenumber as segment,
               l_shipdate as starttime, {d.plus_s('l_shipdate', d.whole('l_quantity') + ' - 10')} as endtime,
               {d.whole('l_quantity * 3')} as rows, {d.whole('l_extendedprice')} as bytes,
               {d.div(d.whole('l_quantity'), '10')} as packets
        from $lineitem where l_returnflag = 'R'"""
    b["steplog"] = f"""
        select l_orderkey % 50 + 1 as userid, l_orderkey as query, l_suppkey % 16 as slice, l_linenumber as segment,
               cast(l_linenumber % 3 as int) as step,
               case l_linenumber % 3 when 0 then 'scan   tbl=' when 1 then 'hash   tbl=' else 'aggr   tbl=' end
                   || cast(l_partkey % 50 as string) as label,
               {d.plus_s('l_shipdate', 'l_suppkey')} as start_time,
               {d.plus_us('l_shipdate', f"l_suppkey * 1000000 + l_linenumber * {d.whole('l_quantity')} * 1000000 + l_suppkey * 1000")} as end_time,
               l_linenumber * {d.whole('l_quantity')} * 1000000 + l_suppkey * 1000 as elapsed_time,
               {d.whole('l_quantity')} as rows,
               case when l_linenumber = 7 then 0 else {d.whole('l_quantity')} * (1 + l_linenumber) end as rows_pre_filter,
               {d.whole('l_extendedprice')} * 1000 as bytes, l_suppkey * 1048576 as workmem,
               case when l_returnflag = 'R' then 't' else 'f' end as is_rrscan,
               case when l_tax > 0.06 then 't' else 'f' end as is_diskbased,
               case when l_discount > 0.09 then 't' else 'f' end as is_delayed_scan
        from $lineitem"""
    b["stepsummary"] = f"""
        select l_orderkey as query, cast({d.div('l_linenumber', '3')} as int) as stm, l_linenumber as seg,
               cast(l_linenumber % 3 as int) as step, {d.whole('l_quantity')} as maxtime, {d.whole('l_quantity / 2')} as avgtime,
               {d.whole('l_quantity')} as rows, {d.whole('l_extendedprice')} as bytes,
               'scan   tbl=' || cast(l_partkey as string) as label, case when l_tax > 0.06 then 't' else 'f' end as is_diskbased,
               l_suppkey as workmem, case when l_returnflag = 'R' then 't' else 'f' end as is_rrscan,
               case when l_discount > 0.09 then 't' else 'f' end as is_delayed_scan,
               {d.whole('l_quantity * 2')} as rows_pre_filter
        from $lineitem"""
    b["stepstate"] = f"""
        select l_orderkey as query, l_suppkey % 16 as slice, l_linenumber as segment, cast(l_linenumber % 3 as int) as step,
               l_partkey as tasknum, 'scan tbl=' || cast(l_partkey as string) as label, l_shipdate as starttime,
               {d.plus_s('l_shipdate', 'l_linenumber * 60 + l_suppkey')} as currenttime,
               {d.whole('l_quantity * 1000')} as rows, {d.whole('l_extendedprice * 1000')} as bytes, cast(0 as int) as num_parts
        from $lineitem"""
    b["planlog"] = """
        select l_orderkey % 50 + 1 as userid, l_orderkey as query, cast(l_linenumber - 1 as int) as nodeid,
               cast(l_linenumber - 2 as int) as parentid,
               case when count(*) > 1 then 'XN Seq Scan on facts_' || cast(min(l_partkey) % 50 as string) || ' missing statistics'
                    else 'XN Hash Join' end as plannode,
               case l_linenumber % 3 when 0 then 'Filter: (qty > ' || cast(max(l_partkey) % 10 as string) || ')'
                    when 1 then 'Join Filter: (a = b)' end as info
        from $lineitem group by l_orderkey, l_linenumber"""
    b["planinfo"] = """
        select l_orderkey % 50 + 1 as userid, l_orderkey as query, cast(l_linenumber - 1 as int) as nodeid,
               l_linenumber as segment, cast(l_linenumber % 3 as int) as step
        from $lineitem group by l_orderkey, l_linenumber"""
    b["alertlog"] = """
        select l_orderkey % 50 + 1 as userid, l_orderkey as query, l_suppkey % 16 as slice, l_linenumber as segment,
               cast(l_linenumber % 3 as int) as step,
               case l_linenumber when 1 then 'Very selective query filter:ratio=rows(1)' when 2 then 'Scanned a large number of deleted rows:rows'
                    when 3 then 'Nested Loop Join in the query plan' when 4 then 'Distributed a large number of rows across the network: hash'
                    when 5 then 'Broadcasted a large number of rows across the network: bcast' when 6 then 'Missing query planner statistics: t'
                    else 'Another event: x' end as event,
               case l_linenumber when 1 then 'Review the choice of sort key to enable range restricted scans, or run VACUUM'
                    when 2 then 'Run the VACUUM command to reclaim deleted space' when 6 then 'Run the ANALYZE command'
                    else 'Review the join predicates' end as solution, l_shipdate as event_time
        from $lineitem where l_discount >= 0.08"""
    b["compilelog"] = f"""
        select l_orderkey % 50 + 1 as userid, {d.div('l_orderkey', '3')} as xid, l_partkey as pid, l_orderkey as query,
               l_linenumber as segment, cast(0 as int) as locus, l_shipdate as starttime,
               {d.plus_us('l_shipdate', d.whole('l_quantity') + ' * 1000')} as endtime,
               cast(case when l_returnflag = 'N' then 1 else 0 end as int) as compile
        from $lineitem"""
    b["agglog"] = f"""
        select l_orderkey as query, l_suppkey % 16 as slice, l_linenumber as segment, 1000 + l_partkey as tbl,
               {d.whole('l_extendedprice')} as bytes, l_suppkey as slots, {d.whole('l_quantity')} as occupied,
               l_linenumber as maxlength, case when l_tax > 0.06 then 't' else 'f' end as is_diskbased,
               l_suppkey * 1024 as workmem, case when l_returnflag = 'A' then 'hashed' else 'plain' end as type,
               {d.whole('l_quantity')} as rows
        from $lineitem"""
    b["insertlog"] = """
        select l_orderkey as query, 1000 + l_partkey as tbl, l_suppkey % 16 as slice
        from $lineitem where l_returnflag = 'A'"""
    b["deletelog"] = """
        select l_orderkey as query, 1000 + l_partkey as tbl, l_suppkey % 16 as slice
        from $lineitem where l_returnflag = 'R'"""
    b["filelog"] = f"""
        select l_orderkey % 500 as query, l_suppkey % 16 as slice, case when l_tax > 0.07 then 'HEAD' else 'GET' end as http_method,
               {d.us('l_shipdate')} + l_linenumber * 1000000 as start_time,
               {d.us('l_shipdate')} + (l_linenumber + {d.whole('l_quantity')}) * 1000000 as end_time,
               {d.whole('l_extendedprice')} * 1024 as transfer_size, {d.whole('l_extendedprice')} * 3072 as data_size,
               {d.whole('l_quantity')} * 10000000 as transfer_time, {d.whole('l_quantity')} * 1000000 as compression_time,
               l_linenumber * 1000 as connect_time, l_linenumber * 2000 as app_connect_time,
               cast(l_linenumber % 3 as bigint) as retries, l_shipdate as recordtime
        from $lineitem"""
    b["loadcommits"] = f"""
        select l_orderkey % 500 as query, l_suppkey % 16 as slice,
               {d.plus_s('l_shipdate', 'l_linenumber * 3600 + l_partkey')} as curtime,
               'part-' || cast(l_orderkey as string) || '-' || cast(l_partkey as string) || '-' || cast(l_linenumber as string) as filename
        from $lineitem"""
    b["loadstate"] = """
        select l_orderkey % 500 as query, l_suppkey % 16 as slice, l_partkey as pid, cast(sum(l_linenumber) as bigint) as lines_scanned,
               count(*) as num_files from $lineitem group by 1, 2, 3"""

    # ---- sessions, locks and errors from the event stream
    b["loaderrors"] = """
        select event_id % 100 as query, 1000 + user_id as tbl, ts as starttime, 's/part-' || cast(user_id as string) as filename,
               event_id as line_number, 'k' as colname, 'int4' as type, '0' as col_length, props as raw_field_value,
               cast(1207 as int) as err_code, 'Invalid digit' as err_reason, user_id + 1 as userid
        from $events where event_type = 'error'"""
    b["errorlog"] = f"""
        select user_id + 1 as userid, 'proc' || cast(user_id % 3 as string) as process, ts as recordtime, user_id as pid,
               cast(1000 + event_id % 7 as int) as errcode, ' exec.cpp ' as file, event_id as linenum, ' ctx ' as context,
               '  ' || props || ' ' as error
        from $events where event_type = 'error'"""
    b["rexmitlog"] = f"""
        select ts as recordtime, user_id % 16 as src_slice, (user_id * 7 + 3) % 16 as dst_slice,
               {d.whole('value * 1000')} as len
        from $events"""
    b["connlog"] = f"""
        select case event_type when 'signup' then 'initiating session' when 'view' then 'authenticated'
                    when 'click' then 'set application_name' when 'error' then 'disconnecting session'
                    else 'Terminating backend on administrator''s request' end as event,
               ts as recordtime, 'host' || cast(user_id % 10 as string) || ' ' as remotehost, cast(40000 + user_id as string) as remoteport,
               user_id as pid, 'db' || cast(user_id % 3 as string) || ' ' as dbname, 'u' || cast(user_id % 50 as string) || '  ' as username,
               'password' as authmethod, case when event_type = 'error' then {d.whole('value * 100')} * 1000000 else 0 end as duration,
               'TLSv1.2 ' as sslversion, 'ECDHE ' as sslcipher, cast(1500 as int) as mtu, 'app' || props as application_name
        from $events"""
    b["sessions"] = f"""
        select user_id as process, 'u' || cast(user_id % 50 as string) as user_name, 'db' || cast(user_id % 3 as string) as db_name,
               {d.plus_s('max(ts)', '-2')} as starttime
        from $events where event_type = 'view' group by user_id"""
    b["recents"] = f"""
        select user_id as pid, 'u' || cast(user_id % 50 as string) as user_name, 'db' || cast(user_id % 3 as string) as db_name,
               {d.plus_s('max(ts)', '-60')} as starttime, case when user_id % 3 = 0 then 'Running' else 'Done' end as status,
               'select ' || cast(user_id as string) as query, count(*) * 1000 as duration
        from $events group by user_id"""
    b["activity"] = """
        select user_id as procpid, 'u' || cast(user_id % 50 as string) as usename, 'select ' || cast(user_id as string) as current_query,
               max(ts) as query_start from $events group by user_id"""
    mode = """case event_type when 'view' then 'AccessShareLock' when 'click' then 'ShareRowExclusiveLock'
              when 'purchase' then 'AccessExclusiveLock' when 'signup' then 'ShareLock' else 'ExclusiveLock' end"""
    b["locks"] = f"""
        select user_id as pid, 1000 + user_id % 40 as relation, 1 + user_id % 5 as database, event_id as transaction,
               {mode} as mode, event_type <> 'error' and event_id % 5 <> 0 as granted
        from $events"""
    b["txns"] = f"""
        select 'u' || cast(user_id % 50 as string) as txn_owner, 'db' || cast(user_id % 3 as string) as txn_db, event_id as xid, user_id as pid,
               ts as txn_start, {mode} as lock_mode,
               case when event_type = 'signup' then 'transactionid' else 'relation' end as lockable_object_type,
               1000 + user_id % 40 as relation, event_type <> 'error' as granted
        from $events"""

    # ---- storage layout
    b["slices"] = f"select distinct s_suppkey % 16 as slice, {d.div('s_suppkey % 16', '4')} as node from $supplier"
    b["partitions"] = f"""
        select s_suppkey % 4 as owner, {d.div('s_suppkey', '4')} % 4 as host, s_suppkey as diskno,
               cast(case when s_nationkey % 5 = 0 then 1 else 0 end as int) as part_begin, {d.whole('s_acctbal + 2000')} as used,
               cast(s_nationkey * 10 as bigint) as tossed, cast(20000 as bigint) as capacity
        from $supplier"""
    b["tableperm"] = f"""
        select l_suppkey % 16 as slice, 1000 + l_partkey as id, 'facts_' || cast(l_partkey as string) as name,
               cast(sum({d.whole('l_quantity')}) as bigint) as rows, cast(sum(case when l_linestatus = 'F' then {d.whole('l_quantity')} else 0 end) as bigint) as sorted_rows,
               1 + l_partkey % 5 as db_id, max(l_linenumber) as delete_pristine
        from $lineitem group by l_suppkey % 16, l_partkey"""
    b["blocks"] = f"""
        select 1000 + l_partkey % 100 as tbl, 'facts_' || cast(l_partkey % 100 as string) as name, l_suppkey % 16 as slice, l_linenumber as col,
               l_orderkey as blocknum, {d.whole('l_quantity')} * 3000 - 3000 as num_values,
               cast(case when l_linestatus = 'O' then 1 else 0 end as int) as unsorted,
               cast(case when l_returnflag = 'R' then 1 else 0 end as int) as tombstone
        from $lineitem"""
    b["rawblocks"] = """
        select l_partkey % 12 - 6 as tbl, l_suppkey % 16 as slice, cast(case when l_returnflag = 'R' then 1 else 0 end as int) as tombstone
        from $lineitem"""
    b["tableinfo"] = f"""
        select 'db' || cast(1 + p_partkey % 5 as string) as database, lower(n_name) as schema_name, 1000 + p_partkey as table_id,
               'facts_' || cast(p_partkey as string) as table_name, case when p_size % 2 = 0 then 'Y' else 'N' end as encoded,
               case p_size % 3 when 0 then 'EVEN' when 1 then 'KEY(col_1)' else 'ALL' end as diststyle,
               case when p_size % 4 <> 0 then 'col_' || cast(p_size % 4 as string) end as sortkey1,
               case when p_size % 4 = 1 then 'none' end as sortkey1_enc, cast(p_size * 10 as int) as max_varchar,
               {d.whole('p_retailprice * 1000')} as size, p_size % 17 as pct_used, p_size % 40 as unsorted, p_size % 30 as stats_off,
               p_partkey * 10 as tbl_rows, p_size % 7 as skew_rows, case when p_size % 5 = 0 then p_size end as skew_sortkey1
        from $part join $nation on n_nationkey = p_partkey % 25"""

    b["statind"] = """
        select 1000 + p_partkey as stairelid, p_partkey * 10 as stairows, cast(p_size as bigint) as staiins, cast(p_size % 7 as bigint) as staidels
        from $part"""

    # ---- catalog snapshots; every key carries its cluster
    b["ns"] = """
        select n_nationkey % 5 as cluster_id, cast(n_nationkey + 1 as bigint) as oid,
               case when n_nationkey % 7 = 3 then n_name else lower(n_name) end as nspname, cast(n_nationkey as bigint) as nspowner,
               $[ 'u' || cast(n_nationkey as string) || '=UC/u' || cast(n_nationkey as string) ;
                  'u' || cast(n_nationkey + 5 as string) || '=U/u' || cast(n_nationkey as string) ;
                  '=U/u' || cast(n_nationkey as string) $] as nspacl
        from $nation"""
    b["class"] = f"""
        select p_partkey % 5 as cluster_id, 1000 + p_partkey as oid, 'facts_' || cast(p_partkey as string) as relname,
               p_partkey % 25 + 1 as relnamespace, case when p_size % 4 = 0 then 'v' else 'r' end as relkind,
               p_partkey % 100 as relowner, cast(case p_size % 4 when 1 then 0 when 2 then 1 when 3 then 8 else 9 end as int) as reldiststyle,
               {d.whole('p_retailprice / 2')} as reltuples, cast(p_size % 9 as int) as relnatts,
               $[ 'u' || cast(p_partkey % 100 as string) || '=arwdRxt/u' || cast(p_partkey % 100 as string) ;
                  'u' || cast((p_partkey + 15) % 100 as string) || case when p_size % 2 = 0 then '=r*w/u' else '=arwdRxt/u' end || cast(p_partkey % 100 as string) ;
                  '"group g' || cast({d.div('p_partkey % 100', '5')} % 4 as string) || '"=ar/u' || cast(p_partkey % 100 as string) ;
                  case when p_size % 3 = 0 then '=r/u' else 'u' || cast((p_partkey + 40) % 100 as string) || '=dx/u' end || cast(p_partkey % 100 as string) $] as relacl
        from $part"""
    b["attrs"] = """
        select l_partkey % 5 as cluster_id, 1000 + l_partkey as attrelid, cast(l_linenumber as int) as attnum,
               case when l_linenumber = 7 then 'Order Col' else 'col_' || cast(l_linenumber as string) end as attname,
               case l_linenumber % 4 when 0 then 'character varying(256)' when 1 then 'bigint' when 2 then 'numeric(18,2)' else 'character(8)' end as format_type,
               l_linenumber = 1 and l_partkey % 3 = 0 as attisdistkey,
               cast(case when l_linenumber <= 2 and l_partkey % 4 <> 0 then l_linenumber when l_linenumber <= 2 and l_partkey % 8 = 0 then -l_linenumber else 0 end as int) as attsortkeyord,
               cast(case when l_partkey % 6 = 0 then 0 else max(l_linenumber) % 3 end as int) as attencodingtype,
               case when l_partkey % 6 = 0 or l_linenumber % 3 = 0 then 'none' when l_linenumber % 3 = 1 then 'lzo' else 'delta' end as encoding,
               l_linenumber = 1 as attnotnull, l_linenumber = 3 as atthasdef
        from $lineitem group by l_partkey, l_linenumber"""
    b["attrdefaults"] = """
        select l_partkey % 5 as cluster_id, 1000 + l_partkey as adrelid, cast(l_linenumber as int) as adnum, '0' as adsrc
        from $lineitem where l_linenumber = 3 group by l_partkey, l_linenumber"""
    b["colstats"] = """
        select l_partkey % 5 as cluster_id, 1000 + l_partkey as starelid, cast(l_linenumber as int) as staattnum,
               round(min(l_tax), 4) as stanullfrac, cast(max(l_linenumber) as int) as stawidth, cast(count(*) - 2 as bigint) as stadistinct,
               cast(case when l_linenumber % 4 = 0 then 10002 else 1 end as int) as stakind1,
               case when l_linenumber = 4 then '2000-01-01 00:00:00' else cast(cast(min(l_shipdate) as date) as string) || ' 00:00:00' end || '||' || cast(cast(max(l_shipdate) as date) as string) || ' 00:00:00' as stavalues1,
               cast(case when l_linenumber % 4 = 1 then 10002 else 2 end as int) as stakind2,
               cast(cast(min(l_shipdate) as date) as string) || ' 00:00:00||2000-01-01 00:00:00' as stavalues2,
               cast(case when l_linenumber % 4 = 2 then 10002 else 3 end as int) as stakind3,
               cast(cast(min(l_shipdate) as date) as string) || ' 00:00:00||' || cast(cast(max(l_shipdate) as date) as string) || ' 00:00:00' as stavalues3,
               cast(4 as int) as stakind4, cast(null as string) as stavalues4
        from $lineitem group by l_partkey, l_linenumber"""
    b["constraints"] = """
        select p_partkey % 5 as cluster_id, 5000 + p_partkey as oid, 'con_' || cast(p_partkey as string) as conname,
               case when p_size % 3 = 0 then 'p' when p_size % 3 = 1 then 'f' else 'u' end as contype, 1000 + p_partkey as conrelid,
               case when p_size % 3 = 1 and p_partkey >= 5 then 1000 + p_partkey - 5 end as confrelid, p_partkey % 25 + 1 as connamespace,
               case when p_size % 3 = 0 then 'PRIMARY KEY (col_1)' when p_size % 3 = 1 then 'FOREIGN KEY (col_2) REFERENCES facts_' || cast(p_partkey - 5 as string) || '(col_1)'
                    else 'UNIQUE (col_1, col_2)' end as condef
        from $part"""
    b["depend"] = """
        select p_partkey % 5 as cluster_id, 9000000 + p_partkey as objid, 1000 + p_partkey as refobjid, 'i' as deptype from $part where p_size % 4 = 0
        union all
        select p_partkey % 5, 9000000 + p_partkey, 1000 + p_partkey - 5, 'n' from $part where p_size % 4 = 0
        union all
        select p_partkey % 5, 9000000 + p_partkey, 1000 + p_partkey - 10, 'n' from $part where p_size % 4 = 0"""
    b["viewdefs"] = """
        select p_partkey % 5 as cluster_id, 1000 + p_partkey as oid, 'select * from facts_' || cast(p_partkey - 5 as string) || ';' as definition
        from $part where p_size % 8 <> 0"""
    b["proc"] = f"""
        select s_suppkey % 5 as cluster_id, 20000 + s_suppkey as oid, 'f_' || cast(s_suppkey as string) as proname, s_suppkey % 25 + 1 as pronamespace,
               s_suppkey % 100 as proowner, cast(s_nationkey % 2 + 1 as bigint) as prolang,
               case s_nationkey % 3 when 0 then 'v' when 1 then 's' else 'i' end as provolatile, 'bool' as rettype,
               $[ 'a' ; 'b' ; 'c' $] as argnames, $[ 'date' ; 'bigint' ; 'varchar' $] as argtypes, cast(s_nationkey % 4 as int) as nargs,
               'return x' as prosrc, $[ 'u' || cast((s_suppkey + 5) % 100 as string) || '=X/u' || cast(s_suppkey % 100 as string) ; '=X/u' || cast(s_suppkey % 100 as string) $] as proacl
        from $supplier"""
    b["languages"] = """
        select n_nationkey % 5 as cluster_id, cast(case when n_nationkey < 5 then 1 else 2 end as bigint) as oid,
               case when n_nationkey < 5 then 'sql' else 'plpythonu' end as lanname,
               $[ 'u' || cast(n_nationkey as string) || '=U/u' || cast(n_nationkey as string) ; '=U/u' || cast(n_nationkey as string) $] as lanacl
        from $nation where n_nationkey < 10"""
    b["db"] = """
        select r_regionkey % 5 as cluster_id, cast(r_regionkey + 1 as bigint) as oid, 'db' || cast(r_regionkey + 1 as string) as datname, cast(r_regionkey as bigint) as datdba,
               'UNLIMITED' as datconnlimit, $[ 'u' || cast(r_regionkey + 5 as string) || '=CT/u' || cast(r_regionkey as string) ;
               'u' || cast(r_regionkey + 10 as string) || '=C*T*/u' || cast(r_regionkey as string) $] as datacl
        from $region"""
    b["defacl"] = """
        select n_nationkey % 5 as cluster_id, cast(n_nationkey as bigint) as oid, cast(n_nationkey as bigint) as defacluser,
               cast(case when n_nationkey < 5 then 0 else n_nationkey + 1 end as bigint) as defaclnamespace,
               case when n_nationkey % 2 = 0 then 'r' else 'f' end as defaclobjtype,
               $[ 'u' || cast(n_nationkey + 5 as string) || case when n_nationkey % 2 = 0 then '=r/u' else '=X/u' end || cast(n_nationkey as string) ;
                  case when n_nationkey % 2 = 0 then 'u' || cast(n_nationkey + 10 as string) || '=arwdRxt/u' else '=X/u' end || cast(n_nationkey as string) $] as defaclacl
        from $nation"""
    b["users"] = """
        select c_custkey % 5 as cluster_id, c_custkey as usesysid, 'u' || cast(c_custkey as string) as usename, c_custkey < 5 as usesuper
        from $customer"""
    b["groups"] = f"""
        select c_custkey % 5 as cluster_id, {d.div('c_custkey', '50')} as grosysid,
               case when {d.div('c_custkey', '50')} % 4 = 3 then 'Team ' else 'g' end || cast({d.div('c_custkey', '50')} as string) as groname,
               {d.sorted_list('c_custkey')} as grolist
        from $customer group by c_custkey % 5, {d.div('c_custkey', '50')}"""

    # ---- the catalog on four days: tables come and go, gain columns, change encodings and rights
    for k, x in enumerate(DAYS):
        b[f"class_{x}"] = f"select * from $class where (oid + {k}) % 11 <> 0"
        b[f"attrs_{x}"] = f"""
            select cluster_id, attrelid, attnum, attname, format_type, attnotnull, atthasdef, attisdistkey, attsortkeyord,
                   case when attrelid % 5 = 0 and {k} > 1 then 'zstd' else encoding end as encoding
            from $attrs where attnum < 3 or attrelid % 3 <= {k}"""
    return b


def _arrays(text: str, d) -> str:
    """``$[ a ; b $]`` is an array literal; entries are separated by `` ;``."""
    def build(m):
        return d.arr(*[x.strip() for x in re.split(r"\s;\s", m.group(1))])
    return re.sub(r"\$\[(.*?)\$\]", build, text, flags=re.S)


SPARK_DEFS = {k: _arrays(v, s) for s in [SparkSpelling()] for k, v in definitions(s).items()}
CHECK_DEFS = {k: _arrays(v, s) for s in [CheckSpelling()] for k, v in definitions(s).items()}


class Inputs:
    """Lazily bound inputs of one data folder: ``inputs.queuelog`` is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._bound: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._bound:
            self._bound[name] = self._bind(name)
        return self._bound[name]

    def _bind(self, name: str) -> DataFrame:
        if name in TABLES:
            read = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
            return read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = SPARK_DEFS[name]
        refs = dict.fromkeys(_REF.findall(text))
        return self.spark.sql(_REF.sub(r"{\1}", text), **{r: self[r] for r in refs})


def check_sql(text: str) -> str:
    """Spell a checking query: prepend the bindings it refers to as common table expressions."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for ref in _REF.findall(sql):
            if ref in CHECK_DEFS and ref not in order:
                visit(CHECK_DEFS[ref])
                if ref not in order:
                    order.append(ref)
            elif ref not in CHECK_DEFS and ref not in TABLES:
                raise KeyError(ref)

    visit(text)
    body = _REF.sub(r"\1", text).strip()
    ctes = ", ".join(f'{n} as ({_REF.sub(chr(92) + "1", CHECK_DEFS[n]).strip()})' for n in order)
    if not ctes:
        return body
    if body[:5].lower() == "with ":
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"
