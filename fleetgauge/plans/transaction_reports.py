"""Commit, lock and connection reports on the bound logs."""

from ..operators import connections as conn, transactions as txn
from .registry import add

AS_OF = "2024-02-01 00:00:00"

_COMMIT = """
    select xid, nullif(startqueue, timestamp '2000-01-01') as startqueue, node,
           epoch_us(startwork) // 1000 - epoch_us(case when startqueue = timestamp '2000-01-01' then startwork else startqueue end) // 1000 as queue_ms,
           epoch_us(endtime) // 1000 - epoch_us(startwork) // 1000 as commit_ms, queuelen from $commitlog"""
add("k01_commit_stats", lambda i: txn.commit_stats(i.commitlog), _COMMIT)
add("k01_worst_commits", lambda i: txn.commit_stats(i.commitlog, limit=100), _COMMIT + " order by queuelen desc, queue_ms desc, xid, node limit 100")

add("k02_table_reads_writes",
    lambda i: txn.table_reads_writes(i.querylog, i.scanlog, i.deletelog, i.insertlog, i.conflictlog, i.utilitytext, i.commitlog), """
    with did as (
        select distinct * from (
            select query, tbl, 'R' as operation from $scanlog where type = 2 union all select query, tbl, 'W' from (from $deletelog union all from $insertlog)
            union all select query, table_id, 'A' from $querylog left join $conflictlog on xact_id = xid where aborted <> 0)),
    outcome as (
        select xid, case when bool_or(undone) then 'R' else 'C' end as action, max(endtime) as finished from (
            select xid, endtime, regexp_matches(lower(text), 'rollback|aborted') as undone from $utilitytext where regexp_matches(lower(text), 'rollback|aborted|commit|end')
            union all select xid, endtime, false from $commitlog where node < 0) group by xid)
    select s.xid, s.query, did.tbl, did.operation, s.starttime as statement_start, s.endtime as statement_end, finished as transaction_end, action as transaction_action
    from $querylog s left join did using (query) left join outcome on outcome.xid = s.xid
    union all by name
    select xid, 'C' as operation, nullif(startqueue, timestamp '2000-01-01') as statement_start, endtime as statement_end, endtime as transaction_end, 'C' as transaction_action
    from $commitlog where node < 0""")

_NAMES = "(select c.oid, trim(n.nspname) as schema_name, trim(c.relname) as object_name from $class c join $ns n on n.oid = c.relnamespace and n.cluster_id = c.cluster_id)"
add("k03_conflicts", lambda i: txn.conflicts(i.conflictlog, i["class"], i.ns), f"""
    select schema_name, object_name, xact_id, process_id, xact_start_ts, abort_time from $conflictlog t join {_NAMES} x on x.oid = t.table_id""")
add("k04_conflict_timeline", lambda i: txn.conflict_timeline(i.statementtext, i.conflictlog), """
    select userid, xid, pid, trim(label) as label, starttime, endtime, sequence, type, trim(text) as text
    from $statementtext where xid in (select xact_id from $conflictlog)""")
add("k05_locks_held", lambda i: txn.locks_held(i.locks, i["class"], i.ns, i.activity), f"""
    select schema_name, object_name, database, transaction, pid, usename, mode, granted
    from $locks l join {_NAMES} x on x.oid = l.relation join $activity a on a.procpid = l.pid""")
add("k06_blocking_locks", lambda i: txn.blocking_locks(i.locks, i.txns, i["class"], i.ns, i.db, i.recents, as_of=AS_OF), f"""
    with t as (select * from $txns qualify row_number() over (partition by pid, relation order by txn_start desc) = 1),
    snap as (
        select t.xid, l.pid, t.txn_owner as user_name, d.datname as db_name, l.relation, x.schema_name, x.object_name, l.mode, l.granted,
               t.lockable_object_type as obj_type, t.txn_start, (epoch_us(timestamp '2024-02-01') - epoch_us(t.txn_start)) as held,
               case when not l.granted then round((epoch_us(timestamp '2024-02-01') - epoch_us(r.starttime)) / 1000000.0, 2) end as waiting_s
        from (select distinct pid, relation, database, mode, granted from $locks) l join t on t.pid = l.pid and t.relation = l.relation
             left join {_NAMES} x on x.oid = l.relation left join $db d on d.oid = l.database left join $recents r on r.pid = l.pid),
    b as (select relation, mode, string_agg(cast(pid as varchar), ',' order by pid) as pid_list, max(waiting_s) as max_blocked_s, count(*) as n_blocked
          from snap where not granted group by 1, 2)
    select xid, pid, user_name, db_name, s.relation, schema_name, object_name, s.mode, granted, obj_type, txn_start,
           case when granted then round(held / 1000000.0, 2) end as held_s, case when granted then round(held / 60000000.0, 2) end as held_min,
           case when granted then round(held / 3600000000.0, 2) end as held_h, waiting_s, max_blocked_s, n_blocked, pid_list
    from snap s left join b on s.relation = b.relation and s.granted and (contains(s.mode, 'Exclusive')
         or (contains(s.mode, 'Share') and ends_with(b.mode, 'ExclusiveLock') and not contains(b.mode, 'Share')))""")
add("k07_blocked_by", lambda i: txn.blocked_by(i.locks, i.activity, as_of=AS_OF), """
    with w as (select distinct relation, pid, mode from $locks where not granted),
    g as (select distinct relation, pid, mode from $locks where granted),
    pairs as (select distinct w.relation, w.pid, w.mode, g.pid as by_pid from w join g on g.relation = w.relation and g.pid <> w.pid
              and (contains(g.mode, 'Exclusive') or (contains(g.mode, 'Share') and ends_with(w.mode, 'ExclusiveLock') and not contains(w.mode, 'Share')))),
    best as (select p.*, a.usename, a.current_query, a.query_start, count(*) over (partition by p.relation, p.pid, p.mode) as n,
                    row_number() over (partition by p.relation, p.pid, p.mode order by a.query_start nulls last, p.by_pid) as rn
             from pairs p left join $activity a on a.procpid = p.by_pid)
    select w.relation, w.pid as blocked_pid, w.mode as blocked_mode, a.usename as blocked_user, a.current_query as blocked_statement,
           round((epoch_us(timestamp '2024-02-01') - epoch_us(a.query_start)) / 1000000.0, 2) as blocked_s, coalesce(b.n, 0) as n_blocking,
           b.by_pid as blocking_pid, b.usename as blocking_user, b.current_query as blocking_statement,
           round((epoch_us(timestamp '2024-02-01') - epoch_us(b.query_start)) / 1000000.0, 2) as blocking_s
    from w left join $activity a on a.procpid = w.pid left join best b on b.relation = w.relation and b.pid = w.pid and b.mode = w.mode and b.rn = 1""")
add("k08_lock_order", lambda i: txn.lock_order(i.txns, i.tableinfo), """
    select relation, schema_name, table_name, txn_start, xid, pid, txn_owner, lock_mode, granted
    from $txns t join $tableinfo i on i.table_id = t.relation""")

_SESSION = """
    with numbered as (
        select * replace (trim(dbname) as dbname, trim(remotehost) as remotehost, trim(remoteport) as remoteport, trim(username) as username),
               sum(case when event = 'initiating session' then 1 else 0 end) over (partition by pid, trim(dbname), trim(remotehost), trim(remoteport), trim(username)
                   order by recordtime rows unbounded preceding) as session_no from $connlog)"""
_DUR = """cast({s} // 86400 as varchar) || ' days ' || cast({s} % 86400 // 3600 as varchar) || 'hrs ' || cast({s} % 3600 // 60 as varchar) || 'mins '
          || cast({s} % 60 as varchar) || 'secs'"""
add("c01_connection_summary", lambda i: conn.connection_summary(i.connlog, i.sessions, as_of=AS_OF), _SESSION + f""",
    c as (select pid, dbname, remotehost, remoteport, username, cast(session_no as bigint) as session_no,
                 min(recordtime) filter (where event = 'authenticated') as auth_time, min(recordtime) filter (where event = 'initiating session') as start_time,
                 max(recordtime) filter (where event = 'disconnecting session') as end_time,
                 max(recordtime) filter (where event like 'Terminating%') as kill_time,
                 arg_max(duration, recordtime) filter (where event = 'disconnecting session') as us,
                 trim(arg_max(application_name, recordtime) filter (where event = 'set application_name')) as app_name,
                 max(authmethod) filter (where event = 'initiating session') as authmethod, max(mtu) filter (where event = 'initiating session') as mtu,
                 trim(max(sslversion) filter (where event = 'initiating session')) as sslversion,
                 trim(max(sslcipher) filter (where event = 'initiating session')) as sslcipher
          from numbered group by 1, 2, 3, 4, 5, 6)
    select c.username, c.pid, session_no, auth_time, start_time, end_time, c.dbname, app_name, authmethod,
           case when us > 0 then {_DUR.format(s="(us // 1000000)")} when f.process is not null
                then {_DUR.format(s="(epoch_us(timestamp '2024-02-01') // 1000000 - epoch_us(auth_time) // 1000000)")} end as duration,
           mtu, sslversion, sslcipher, remotehost, remoteport,
           case when kill_time is not null then 'Terminated by administrator' when end_time is not null then 'Disconnected'
                when f.process is not null then 'Active' else 'Connection Lost' end as current_state
    from c left join $sessions f on f.process = c.pid and f.db_name = c.dbname and f.user_name = c.username
         and epoch_us(auth_time) // 1000000 - epoch_us(f.starttime) // 1000000 between 0 and 4
    where auth_time is not null and c.username <> 'rdsdb'""")
add("c02_open_sessions", lambda i: conn.open_sessions(i.connlog), _SESSION + """,
    c as (select pid, remotehost, remoteport, username, session_no, min(recordtime) filter (where event = 'initiating session') as connect_time,
                 min(recordtime) filter (where event = 'disconnecting session') as disconnect_time,
                 arg_min(duration, recordtime) filter (where event = 'disconnecting session') as duration_us
          from numbered group by dbname, 1, 2, 3, 4, 5)
    select case when disconnect_time is null then 'Y' else 'N' end as connected, connect_time, disconnect_time, pid, remotehost, remoteport, username, duration_us
    from c where connect_time is not null""")
_LEAK = """
    select trim(remotehost) as remotehost, trim(username) as username, count(*) filter (where event = 'initiating session') as connects,
           nullif(count(*) filter (where event = 'disconnecting session'), 0) as disconnects
    from $connlog group by 1, 2 having count(*) filter (where event = 'initiating session') > 0"""
add("c03_session_leakage", lambda i: conn.session_leakage(i.connlog), _LEAK)
add("c03_worst_leaks", lambda i: conn.session_leakage(i.connlog, limit=20),
    _LEAK + " order by connects - coalesce(disconnects, 0) desc, remotehost, username limit 20")
add("c04_recent_connections", lambda i: conn.recent_connections(i.connlog, as_of=AS_OF, lookback=31), """
    select trim(event) as event, recordtime, trim(remotehost) as remotehost, trim(remoteport) as remoteport, pid, trim(dbname) as dbname,
           trim(username) as username, trim(authmethod) as authmethod, duration, trim(sslversion) as sslversion, trim(sslcipher) as sslcipher, mtu,
           trim(application_name) as application_name from $connlog""")
