"""Connection reports from the event log of sessions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.temporal import at, boundary_diff, epoch_us, human_duration, int_div, US
from ..functions.text import trimmed
from .ordered import running_total
from .rows import recent

# Events of a connection's life.
INITIATED = "initiating session"
AUTHENTICATED = "authenticated"
APPLICATION = "set application_name"
DISCONNECTED = "disconnecting session"
TERMINATED = "Terminating backend on administrator's request"
INTERNAL_USER = "rdsdb"
_KEY = ["pid", "dbname", "remotehost", "remoteport", "username"]


def numbered_sessions(connlog: DataFrame, fleet: Sequence[str] = ()) -> DataFrame:
    """The log with a session number per connection key: process ids are reused over time.

    The number counts session starts up to each event. It is carried from day to day, so a process
    id with a very long history is not sorted in one task.
    """
    texts = ["dbname", "remotehost", "remoteport", "username"]
    log = connlog.withColumns({c: F.coalesce(trimmed(c), F.lit("")) for c in texts}).withColumns({
        "event": trimmed("event"), "__start": (trimmed("event") == INITIATED).cast("int"), "__us": epoch_us("recordtime")})
    log = log.withColumn("__later", 1 - F.col("__start"))
    return running_total(log, [*fleet, *_KEY], ["__us", "__later"], int_div(F.col("__us"), US["day"]), {"session_no": "__start"}).drop(
        "__start", "__later", "__us")


def _when(event: str, value) -> Column:
    return F.when(F.col("event") == event, value)


def connection_summary(connlog: DataFrame, sessions: DataFrame, *, as_of, fleet: Sequence[str] = ()) -> DataFrame:
    """One row per authenticated connection: times, client, readable duration and state."""
    t = F.col("recordtime")
    first = lambda event, col: F.min_by(col, _when(event, t))
    last = lambda event, col: F.max_by(col, _when(event, t))
    c = numbered_sessions(connlog, fleet).groupBy(*fleet, *_KEY, "session_no").agg(
        F.min(_when(AUTHENTICATED, t)).alias("auth_time"), F.min(_when(INITIATED, t)).alias("start_time"),
        F.max(_when(DISCONNECTED, t)).alias("end_time"), F.max(_when(TERMINATED, t)).alias("kill_time"),
        last(DISCONNECTED, "duration").alias("us"), trimmed(last(APPLICATION, "application_name")).alias("app_name"),
        trimmed(first(INITIATED, "authmethod")).alias("authmethod"), first(INITIATED, "mtu").alias("mtu"),
        trimmed(first(INITIATED, "sslversion")).alias("sslversion"), trimmed(first(INITIATED, "sslcipher")).alias("sslcipher"),
    ).where(F.col("auth_time").isNotNull() & (F.col("username") != INTERNAL_USER))
    s = sessions.select(*fleet, F.col("process").alias("pid"), trimmed("db_name").alias("dbname"), trimmed("user_name").alias("username"),
                        F.col("starttime").alias("live_start"))
    gap = boundary_diff("second", "live_start", "auth_time")
    live = reduce(lambda a, k: a & (c[k] == s[k]), fleet, c["pid"] == s["pid"]) & (c["dbname"] == s["dbname"]) & (c["username"] == s["username"]) & gap.between(0, 4)
    j = c.join(s.select("*", F.lit(True).alias("live")), live, "left").select(c["*"], "live")
    lasted = F.when(F.col("us") > 0, human_duration(int_div("us", US["second"]))).when(
        F.col("live"), human_duration(boundary_diff("second", "auth_time", at(as_of))))
    state = (F.when(F.col("kill_time").isNotNull(), "Terminated by administrator").when(F.col("end_time").isNotNull(), "Disconnected")
             .when(F.col("live"), "Active").otherwise("Connection Lost"))
    return j.select(*fleet, "username", "pid", "session_no", "auth_time", "start_time", "end_time", "dbname", "app_name", "authmethod",
                    lasted.alias("duration"), "mtu", "sslversion", "sslcipher", "remotehost", "remoteport", state.alias("current_state"))


def open_sessions(connlog: DataFrame, *, fleet: Sequence[str] = ()) -> DataFrame:
    """Each started session, whether it is still connected, and its end if it has one."""
    t = F.col("recordtime")
    return numbered_sessions(connlog, fleet).groupBy(*fleet, *_KEY, "session_no").agg(
        F.min(_when(INITIATED, t)).alias("connect_time"), F.min(_when(DISCONNECTED, t)).alias("disconnect_time"),
        F.min_by("duration", _when(DISCONNECTED, t)).alias("duration_us")).where("connect_time is not null").select(
        *fleet, F.when(F.col("disconnect_time").isNull(), "Y").otherwise("N").alias("connected"), "connect_time", "disconnect_time",
        "pid", "remotehost", "remoteport", "username", F.when(F.col("disconnect_time").isNotNull(), F.col("duration_us")).alias("duration_us"))


def session_leakage(connlog: DataFrame, *, limit: int | None = None, fleet: Sequence[str] = ()) -> DataFrame:
    """Connects against disconnects per host and user, largest surplus first."""
    event = trimmed("event")
    out = connlog.groupBy(*fleet, trimmed("remotehost").alias("remotehost"), trimmed("username").alias("username")).agg(
        F.count_if(event == INITIATED).alias("connects"), F.nullif(F.count_if(event == DISCONNECTED), F.lit(0)).alias("disconnects")
    ).where("connects > 0")
    surplus = F.col("connects") - F.coalesce("disconnects", F.lit(0))
    return out if limit is None else out.orderBy(surplus.desc(), "remotehost", "username").limit(limit)


def recent_connections(connlog: DataFrame, *, as_of=None, lookback: float | None = None) -> DataFrame:
    """Trimmed connection events of the last hours."""
    return recent(connlog, "recordtime", as_of, lookback).select(
        trimmed("event").alias("event"), "recordtime", *[trimmed(c).alias(c) for c in ("remotehost", "remoteport")], "pid",
        *[trimmed(c).alias(c) for c in ("dbname", "username", "authmethod")], "duration",
        *[trimmed(c).alias(c) for c in ("sslversion", "sslcipher")], "mtu", trimmed("application_name").alias("application_name"))
