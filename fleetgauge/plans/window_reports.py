"""Reports over windows that leave most of the logs out, and from logs stored by day and statement."""

import re
import uuid

from ..operators import layout, loads, performance, queue
from ..session import shared_dir
from ..sources.logstore import store_log
from . import layout_reports, performance_reports, queue_reports  # noqa: F401
from .registry import TEXTS, add

EVENTS = {"as_of": "2024-01-20 06:00:00", "lookback": 9}
EVENTS_EDGE = "2024-01-11 06:00:00"
ORDERS = {"as_of": "1997-03-01 00:00:00", "lookback": 200}
ORDERS_EDGE = "1996-08-13 00:00:00"


def _bounded(name: str, **logs: str) -> str:
    """The checking query of a report with some of its logs cut down by a condition."""
    sql = TEXTS[name]
    for log, condition in logs.items():
        sql, n = re.subn(rf"\${log}\b", lambda _: f"(select * from ${log} where {condition})", sql)
        assert n, (name, log)
    return sql


def _within(ts: str, window: dict, edge: str) -> str:
    return f"{ts} between timestamp '{edge}' and timestamp '{window['as_of']}'"


def _events(ts: str) -> str:
    return _within(ts, EVENTS, EVENTS_EDGE)


def _orders(ts: str) -> str:
    return _within(ts, ORDERS, ORDERS_EDGE)


_Q09 = _bounded("q09_queue_resources_hourly", queuelog=_events("exec_start_time"), cachelog=_events("starttime"))
add("q09_resources_in_window", lambda i: queue.queue_resources_hourly(i.queuelog, i.metrics, i.cachelog, **EVENTS), _Q09)
add("qp01_top_in_window", lambda i: performance.top_queries(i.querylog, i.alertlog, **ORDERS),
    _bounded("qp01_all_queries", querylog=_orders("starttime"), alertlog=_orders("event_time")))
add("qp02_resources_in_window", lambda i: performance.top_queries_resources(i.queue_querylog, i.metrics, i.alertlog, i.utilitytext, **EVENTS),
    _bounded("qp02_top_queries_resources", queue_querylog=_events("starttime"), alertlog=_events("event_time")))
add("qp04_alerts_in_window", lambda i: performance.alerts_by_table(i.alertlog, i.scanlog, i.distlog, i.bcastlog, i.tableinfo, **ORDERS),
    _bounded("qp04_alerts_by_table", alertlog=_orders("event_time")))
add("qp08_filters_in_window", lambda i: performance.filters_used(i.planlog, i.planinfo, i.scanlog, **ORDERS),
    _bounded("qp08_filters_used", scanlog=_orders("starttime")))
_Q17 = _bounded("qp17_statement_timeline", queue_querylog=_events("starttime"), queuelog=f"service_class_end_time >= timestamp '{EVENTS_EDGE}'",
                **{log: f"{ts} >= timestamp '{EVENTS_EDGE}'" for log, ts in (("steplog", "end_time"), ("compilelog", "endtime"), ("commitlog", "endtime"))})
add("qp17_timeline_in_window", lambda i: performance.statement_timeline(i.queue_querylog, i.steplog, i.queuelog, i.compilelog, i.commitlog, **EVENTS), _Q17)
add("l01_loads_in_window", lambda i: loads.load_performance(i.filelog, i.querylog, **ORDERS), _bounded("l01_load_performance", filelog=f"""
    end_time <= epoch_us(timestamp '{ORDERS['as_of']}') and query in (select query from $filelog where http_method = 'GET' and query > 0 and transfer_time > 0
        and end_time between epoch_us(timestamp '{ORDERS_EDGE}') and epoch_us(timestamp '{ORDERS['as_of']}'))"""))
add("d05_info_in_window", lambda i: layout.extended_table_info(
    i.tableinfo, i["class"], i.scanlog, i.alertlog, i.planinfo, i.planlog, i.constraints, i.attrs, i.tableperm, i.slices, **ORDERS),
    _bounded("d05_extended_table_info", scanlog=_orders("endtime"), alertlog=_orders("event_time")))


# ---- the same reports from stored logs
def _stored(i, name: str, ts: str | None = None):
    """A binding as a stored log; bindings are of one cluster, so the statement alone is the key."""
    return store_log(i[name], f"log_{name}_{uuid.uuid4().hex}", ts=ts, keys=("query",), buckets=8, path=shared_dir(i.spark, f"log-{name}"))


add("s01_stored_resources", lambda i: queue.queue_resources_hourly(
    _stored(i, "queuelog", "exec_start_time"), _stored(i, "metrics"), i.cachelog, **EVENTS), _Q09)
add("s02_stored_timeline", lambda i: performance.statement_timeline(
    _stored(i, "queue_querylog", "starttime"), i.steplog, _stored(i, "queuelog", "service_class_end_time"), i.compilelog, i.commitlog, **EVENTS), _Q17)
