"""Histories of definitions and rights over the bound catalog snapshots of several days."""

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import ddltext as ddl, history as hist, privileges as priv
from ..session import shared_dir
from ..sources import tables
from .bindings import DAYS
from .catalog_reports import _PRINTS, _REL, _RIGHTS_BY_OBJECT
from .registry import add

TABLE = ["schema_name", "table_name"]
VIEW = ["schema_name", "view_name"]
RIGHT = ["schema_name", "object_name", "object_type", "principal", "principal_kind"]


def _on(day: str, df: DataFrame) -> DataFrame:
    return df.withColumn("snapshot_ts", F.lit(DAYS[day]).cast("timestamp_ntz"))


def _all(build, days=DAYS) -> DataFrame:
    return reduce(DataFrame.unionByName, [_on(x, build(x)) for x in days])


def _tables(i, days=DAYS):
    def prints(x):
        text = ddl.table_ddl_text(i[f"class_{x}"], i.ns, i[f"attrs_{x}"], i.attrdefaults, i.constraints, i.users)
        return ddl.ordered_fragments(text, ["cluster_id", "table_id", *TABLE]).select("cluster_id", *TABLE, "fingerprint")

    return tables.create_table_as(_all(prints, days), shared_dir(i.spark, "fingerprints"))


def _rights(i):
    """The rights of a principal on an object as one fingerprint."""
    def prints(x):
        held = priv.effective_table_privileges(i[f"class_{x}"], i.ns, i.users, i.groups)
        text = F.concat_ws(",", *[F.when(F.col(r), F.lit(r)) for r in priv.TABLE_RIGHTS])
        return hist.fingerprinted(held.where("principal_kind <> 'superuser'").withColumn("rights", text), ["cluster_id", *RIGHT], "rights")

    return _all(prints)


def _views(i):
    return _all(lambda x: hist.fingerprinted(ddl.view_ddl_text(i[f"class_{x}"], i.ns, i.viewdefs), ["cluster_id", *VIEW]))


def _daily(sql: str, days=DAYS) -> str:
    """A checking query over the bindings of every day, with the day as ``snapshot_ts``."""
    of_day = lambda x: re.sub(r"\$(class|attrs)\b", rf"$\1_{x}", sql)
    return " union all ".join(f"select timestamp '{DAYS[x]}' as snapshot_ts, * from ({of_day(x)})" for x in days)


def _stretches(snapshots: str, keys: list[str]) -> str:
    """Checking query of a history: maximal runs of neighbouring snapshots with one fingerprint."""
    k = ", ".join(["cluster_id", *keys])
    return f"""
        with snaps as ({snapshots}),
        clock as (select *, row_number() over (partition by cluster_id order by snapshot_ts) as tick from (select distinct cluster_id, snapshot_ts from snaps)),
        numbered as (select snaps.*, tick, tick - row_number() over (partition by {k}, fingerprint order by tick) as run from snaps join clock using (cluster_id, snapshot_ts)),
        runs as (select {k}, fingerprint, run, min(snapshot_ts) as valid_from, max(tick) + 1 as after, count(*) as n_snapshots from numbered group by {k}, fingerprint, run)
        select {', '.join('runs.' + c for c in ['cluster_id', *keys])}, fingerprint, valid_from, clock.snapshot_ts as valid_to, n_snapshots
        from runs left join clock on clock.cluster_id = runs.cluster_id and clock.tick = runs.after"""


_TABLE_SNAPS = _daily(f"select cluster_id, schema_name, table_name, fingerprint from ({_PRINTS})")
_TABLE_HISTORY = _stretches(_TABLE_SNAPS, TABLE)
add("g12_definition_history", lambda i: hist.interval_history(_tables(i), TABLE), _TABLE_HISTORY)


def _merged(i):
    """Three days' history, and the fourth day merged into it."""
    return hist.merge_snapshot(hist.interval_history(_tables(i, "abc"), TABLE), _tables(i, "d"), TABLE)


def _grown(i):
    """A stored history that grows by a snapshot at a time."""
    path = shared_dir(i.spark, "history")
    for x in DAYS:
        grown = hist.append_snapshot(_tables(i, x), path, TABLE, DAYS[x])
    return grown


add("g12_history_merge", _merged, _TABLE_HISTORY)
add("g12_history_store", _grown, _TABLE_HISTORY)
add("g12_definitions_as_of", lambda i: hist.state_as_of(hist.interval_history(_tables(i), TABLE), "2024-01-03 12:00:00").select("cluster_id", *TABLE, "fingerprint"),
    f"select cluster_id, schema_name, table_name, fingerprint from ({_TABLE_SNAPS}) where snapshot_ts = timestamp '2024-01-02'")


def _drift(snapshots: str, keys: list[str]) -> str:
    """Checking query of drift: each snapshot compared with the next one of its cluster."""
    same = " and ".join(f"b.{k} = n.{k}" for k in keys)
    return f"""
        with snaps as ({snapshots}),
        steps as (select cluster_id, snapshot_ts as s, lead(snapshot_ts) over (partition by cluster_id order by snapshot_ts) as e from (select distinct cluster_id, snapshot_ts from snaps)),
        before as (select steps.e, snaps.* from snaps join steps on steps.cluster_id = snaps.cluster_id and steps.s = snapshot_ts where e is not null),
        now as (select steps.e, snaps.* from snaps join steps on steps.cluster_id = snaps.cluster_id and steps.e = snapshot_ts),
        pairs as (select coalesce(b.cluster_id, n.cluster_id) as cluster_id, coalesce(b.e, n.e) as e, b.fingerprint as was, n.fingerprint as is_now
                  from before b full join now n on b.cluster_id = n.cluster_id and b.e = n.e and {same})
        select cluster_id, cast(e as date) as day, count(*) filter (was is null) as created, count(*) filter (was <> is_now) as changed,
               count(*) filter (is_now is null) as dropped from pairs where was is distinct from is_now group by all"""


add("g12_drift_by_day", lambda i: hist.drift_by_day(hist.interval_history(_tables(i), TABLE), TABLE), _drift(_TABLE_SNAPS, TABLE))

_VIEW_SNAPS = _daily(f"""
    select c.cluster_id, schema_name, relname as view_name, md5('--DROP VIEW ' || n || ';' || chr(10)
           || case when relnatts > 0 then 'CREATE OR REPLACE VIEW ' || n || ' AS' || chr(10) else '' end || coalesce(definition, '')) as fingerprint
    from (select *, if(regexp_full_match(schema_name, '[a-z_][a-z0-9_]*'), schema_name, '"' || schema_name || '"') || '.' || relname as n from {_REL}) c
         left join $viewdefs v on v.oid = c.oid and v.cluster_id = c.cluster_id where relkind = 'v'""")
add("g14_view_history", lambda i: hist.interval_history(_views(i), VIEW), _stretches(_VIEW_SNAPS, VIEW))
_RIGHT_SNAPS = _daily(f"""
    select cluster_id, schema_name, object_name, object_type, principal, principal_kind,
           md5(concat_ws(',', {', '.join(f"case when {r} then '{r}' end" for r in priv.TABLE_RIGHTS)})) as fingerprint
    from ({_RIGHTS_BY_OBJECT}) where principal_kind <> 'superuser'""")
add("g17_rights_history", lambda i: hist.interval_history(_rights(i), RIGHT), _stretches(_RIGHT_SNAPS, RIGHT))
add("g17_rights_drift", lambda i: hist.drift_by_day(hist.interval_history(_rights(i), RIGHT), RIGHT), _drift(_RIGHT_SNAPS, RIGHT))


def _events_at(i):
    """What the table of a lineitem looked like when it was shipped (years moved into the snapshots' days)."""
    moved = F.expr("timestampadd(DAY, cast(l_orderkey % 5 as int), timestamp_ntz '2023-12-31 12:00:00')")
    asked = i.lineitem.select((F.col("l_partkey") % 5).alias("cluster_id"), F.concat(F.lit("facts_"), "l_partkey").alias("table_name"), moved.alias("ts"))
    known = hist.interval_history(_tables(i).drop("schema_name"), ["table_name"])
    found = hist.state_at(asked, known, ["table_name"], "ts")
    return found.groupBy("cluster_id", "ts").agg(F.count("*").alias("n"), F.count("fingerprint").alias("n_known"), F.count_distinct("fingerprint").alias("n_states"))


add("g12_definitions_at_events", _events_at, f"""
    with snaps as ({_TABLE_SNAPS}),
    asked as (select l_partkey % 5 as cluster_id, 'facts_' || l_partkey as table_name, timestamp '2023-12-31 12:00:00' + to_days(cast(l_orderkey % 5 as int)) as ts from lineitem),
    latest as (select cluster_id, ts, max(snapshot_ts) as snapshot_ts from (select distinct cluster_id, ts from asked) join (select distinct cluster_id, snapshot_ts from snaps) using (cluster_id)
               where snapshot_ts <= ts group by all)
    select cluster_id, ts, count(*) as n, count(fingerprint) as n_known, count(distinct fingerprint) as n_states
    from asked left join latest using (cluster_id, ts) left join snaps using (cluster_id, snapshot_ts, table_name) group by all""")
