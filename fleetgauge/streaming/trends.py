"""The same reports over growing logs: append-only files read as a stream.

Each function takes a streaming (or batch) DataFrame and keeps bounded state behind a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.alerts import alert_kind
from ..operators.connections import DISCONNECTED, INITIATED


def log_stream(spark: SparkSession, folder: str, schema, *, pattern: str = "*.parquet") -> DataFrame:
    """Files arriving in a folder, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def _event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", delay)


def queue_trend_stream(queuelog: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Queued and executed time per class and tumbling hour."""
    w = _event_time(queuelog, "service_class_start_time", delay)
    return w.groupBy(F.window("__t", "1 hour").alias("w"), "service_class").agg(
        F.count("query").alias("query_count"), F.sum("total_queue_time").alias("queue_us"), F.sum("total_exec_time").alias("exec_us")).select(
        F.col("w.start").cast("timestamp_ntz").alias("hour"), "service_class", "query_count", "queue_us", "exec_us")


def connection_pairs_stream(connlog: DataFrame, *, delay: str = "1 hour", longest: str = "2 hours") -> DataFrame:
    """Session starts with the disconnects of the same process that follow within ``longest``."""
    keys = ["pid", "remotehost", "remoteport"]
    starts = _event_time(connlog.where(F.col("event") == INITIATED), "recordtime", delay).select(
        *keys, F.col("recordtime").alias("connect_time"), F.col("__t").alias("__start"))
    ends = _event_time(connlog.where(F.col("event") == DISCONNECTED), "recordtime", delay).select(
        *[F.col(k).alias(f"e_{k}") for k in keys], F.col("recordtime").alias("disconnect_time"), F.col("__t").alias("__end"))
    same = (F.col("pid") == F.col("e_pid")) & (F.col("remotehost") == F.col("e_remotehost")) & (F.col("remoteport") == F.col("e_remoteport"))
    later = (F.col("__end") >= F.col("__start")) & (F.col("__end") <= F.col("__start") + F.expr(f"interval {longest}"))
    return starts.join(ends, same & later, "leftOuter").select(*keys, "connect_time", "disconnect_time")


def alert_events_stream(alertlog: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """Each statement's alert kinds once, however often a kind was logged within the delay."""
    a = _event_time(alertlog, "event_time", delay).select("query", alert_kind("event").alias("kind"), "__t")
    return a.dropDuplicatesWithinWatermark(["query", "kind"]).select("query", "kind")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available into a stored table and return it; a restart resumes from the checkpoint."""
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
