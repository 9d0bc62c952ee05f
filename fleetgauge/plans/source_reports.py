"""Loads and exports as real jobs over files in the shared folder, and the streaming variants."""


from pyspark.sql import Window as W, functions as F

from ..operators import sketches
from ..session import shared_dir
from ..sources import delimited, footers, jsonpath, manifest, scan, tables
from ..streaming import trends
from .registry import add

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
STAMP = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def _path(i, purpose):
    return shared_dir(i.spark, purpose)


add("s01_table_scan", lambda i: scan.scan(i.spark, f"{i.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"]), "select l_orderkey, l_quantity from lineitem")
add("s02_time_bounded_scan", lambda i: scan.time_bounded_scan(i.spark, f"{i.sf_dir}/events.parquet", "ts", as_of="2024-01-25", lookback_days=14),
    "select * from events where ts between timestamp '2024-01-11' and timestamp '2024-01-25'")


def _csv(i):
    path = _path(i, "csv")
    delimited.export_delimited(i.orders, path, sep="\t", gzip=True, header=True, null_token="NULL")
    return delimited.read_delimited(i.spark, path, ORDERS, sep="\t", skip_header=True, null_token="NULL", timestamp_format=STAMP)


def _manifest(i):
    path = _path(i, "listed")
    files = delimited.export_delimited(i.events, path, sep="|", gzip=True)
    manifest.write_manifest(files, path + "-manifest")
    return manifest.load_manifest(i.spark, path + "-manifest", lambda urls: delimited.read_delimited(i.spark, urls, EVENTS, sep="|", timestamp_format=STAMP))


def _json(i):
    path = _path(i, "json")
    doc = F.struct("event_id", F.struct("user_id", "event_type").alias("who"), F.from_json("props", "k int").alias("props"), "value")
    i.events.select(F.to_json(doc).alias("value")).write.mode("overwrite").text(path)
    return jsonpath.read_json_paths(i.spark, path, [
        ("event_id", "$.event_id", "bigint"), ("user_id", "$.who.user_id", "bigint"), ("kind", "$.who.event_type", "string"),
        ("k", "$.props.k", "int"), ("amount", "$.value", "double")])


def _utf8(i):
    path = _path(i, "utf8")
    delimited.export_delimited(i.documents.select("doc_id", "lang", "text"), path, sep="|")
    return delimited.read_delimited(i.spark, path, "doc_id bigint, lang string, text string", sep="|", encoding="UTF-8", multi_line=True)


def _rejects(i):
    """Events as lines that this code writes itself, in order: quoted fields, codes and days of the wrong type."""
    path = _path(i, "mixed")
    code = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("event_id").cast("string"))
    day = F.when(F.col("event_type") == "click", '"2024|13|01"').otherwise(F.date_format("ts", "yyyy-MM-dd"))
    line = F.concat_ws("|", "event_id", code, day, F.concat(F.lit('"'), "event_type", F.lit('"')))
    i.events.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select(line).write.mode("overwrite").text(path)
    return delimited.read_with_rejects(i.spark, path, "event_id bigint, code int, day date, event_type string", sep="|")


def _numbered(i):
    """All events in one file: the rejects' line numbers are their places among all events."""
    path = _path(i, "one-file")
    i.events.select("event_id", F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("user_id").cast("string"))).coalesce(1).sortWithinPartitions(
        "event_id").write.mode("overwrite").option("compression", "gzip").option("header", True).option("quoteAll", True).csv(path)
    return delimited.read_with_rejects(i.spark, path, "event_id bigint, code int", skip_header=True)[1].drop("file_name")


add("s03_csv_load", _csv, "select * from orders")
add("s04_manifest_load", _manifest, "select * from events")
add("s05_json_path_load", _json, "select event_id, user_id, event_type as kind, cast(regexp_extract(props, '(\\d+)', 1) as int) as k, value as amount from events")
add("s06_utf8_load", _utf8, "select doc_id, lang, text from documents")
add("s07_accepted_rows", lambda i: _rejects(i)[0], """
    select event_id, cast(event_id as int) as code, cast(ts as date) as day, event_type from events where event_type not in ('error', 'click')""")
add("s07_rejected_values", lambda i: _rejects(i)[1].drop("file_name", "line_number"), """
    select 'code' as column_name, 'int' as column_type, 'n/a' as raw_value, 'Invalid digit' as reason,
           event_id || '|n/a|' || strftime(ts, '%Y-%m-%d') || '|"error"' as raw_line from events where event_type = 'error'
    union all
    select 'day', 'date', '2024|13|01', 'Invalid date', event_id || '|' || event_id || '|"2024|13|01"|"click"' from events where event_type = 'click'""")
add("s07_reject_line_numbers", _numbered, """
    select 1 + row_number() over (order by event_id) as line_number, 'code' as column_name, 'int' as column_type, 'n/a' as raw_value,
           'Invalid digit' as reason, '"' || event_id || '","n/a"' as raw_line from events qualify event_type = 'error'""")
add("s08_parallel_export", lambda i: delimited.export_delimited(i.lineitem, _path(i, "export"), gzip=True))



def _read_back(i):
    """The rows of the files that the export's own manifest lists."""
    path = _path(i, "back")
    urls = [r.url for r in delimited.export_delimited(i.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), path, gzip=True).collect()]
    return delimited.read_delimited(i.spark, urls, "l_orderkey bigint, l_linenumber int, l_quantity double", sep="|")


add("s08_export_read_back", _read_back, "select l_orderkey, l_linenumber, l_quantity from lineitem")


def _ordered(i):
    path = _path(i, "ordered")
    delimited.export_delimited(i.orders, path, order_by=["o_orderkey"], max_rows_per_file=4000)
    back = i.spark.read.schema(ORDERS).option("sep", "|").csv(path)
    files = back.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return files.agg(F.sum("n").alias("rows"), (F.max("n") <= 4000).alias("pieces_bounded"))


def _pieces(i):
    """Sizes, order and rows of an export in pieces of at most 64 kB."""
    path = _path(i, "pieces")
    files = delimited.export_in_pieces(i.orders, path, max_bytes=65536, order_by=["o_orderdate", "o_orderkey"])
    back = i.spark.read.schema(ORDERS).option("sep", "|").csv(path)
    ends = back.groupBy(F.regexp_extract(F.col("_metadata.file_path"), "/piece=([0-9-]+)/", 1).alias("piece")).agg(
        F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    ordered = F.coalesce(F.lag("last").over(W.orderBy("piece")) <= F.col("first"), F.lit(True))
    return ends.join(files, "piece").withColumn("follows", ordered).agg(
        F.sum("n").alias("rows"), F.bool_and("follows").alias("in_order"), (F.max("bytes") <= 65536).alias("bounded"))


def _published(i):
    path = _path(i, "published")
    manifest.publish(i.spark, path, lambda folder: delimited.export_delimited(i.orders.limit(10), folder))
    manifest.publish(i.spark, path, lambda folder: delimited.export_delimited(i.orders, folder, gzip=True))
    return manifest.load_published(i.spark, path, lambda urls: delimited.read_delimited(i.spark, urls, ORDERS, sep="|", timestamp_format=STAMP))


add("s08_published_export", _published, "select * from orders")
add("s09_pieces_by_size", _pieces, "select count(*) as rows, true as in_order, true as bounded from orders")
add("s09_ordered_export", _ordered, "select count(*) as rows, true as pieces_bounded from orders")
_AGG = "select l_partkey, l_shipdate, sum(l_quantity) as qty from lineitem group by 1, 2"
add("s10_create_table_as", lambda i: tables.create_table_as(
    i.lineitem.groupBy("l_partkey", "l_shipdate").agg(F.sum("l_quantity").alias("qty")), _path(i, "ctas"), sort_within=("l_shipdate",)), _AGG)


def _insert(i):
    path = _path(i, "insert")
    tables.create_table_as(i.orders.where("o_orderstatus = 'F'"), path)
    return tables.insert_into(i.orders.where("o_orderstatus <> 'F'"), path)


def _copy_schema(i):
    path = _path(i, "copy")
    tables.create_table_as(tables.empty_like(i.customer), path)
    return tables.insert_into(i.customer, path)


def _split(i):
    source, target = _path(i, "lines"), _path(i, "pieces")
    i.conversations.select(F.to_json(F.struct("conv_id", "turn", "text")).alias("value")).write.mode("overwrite").text(source)
    delimited.split_file(i.spark, source, target, rows_per_piece=100)
    pieces = i.spark.read.text(target).groupBy("_metadata.file_name").agg(F.count("*").alias("n"))
    return pieces.agg(F.sum("n").alias("rows"), (F.max("n") <= 100).alias("pieces_bounded"))


add("s11_insert_select", _insert, "select * from orders")
add("s11_schema_copy", _copy_schema, "select * from customer")
add("s12_split_file", _split, "select count(*) as rows, true as pieces_bounded from conversations")
_COLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
         ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
add("s13_column_catalog", lambda i: scan.column_catalog(i.lineitem, "lineitem"), " union all ".join(
    f"select 'lineitem' as table_name, '{c}' as column_name, {n} as ordinal, '{t}' as data_type, count(*) as rows, count({c}) as present from lineitem"
    for n, (c, t) in enumerate(_COLS, 1)))


# ---- layout of the stored tables themselves, from their footers
_NUMBERS = [c for c, t in _COLS if t in ("bigint", "int", "double")]


def _feet(i):
    return footers.parquet_footers(i.spark, [f"{i.sf_dir}/lineitem.parquet"])


add("d11_stored_column_cost", lambda i: footers.column_cost(_feet(i)).where(F.col("column").isin(_NUMBERS)).select("column", "n_values", "n_nulls", "low", "high"),
    " union all ".join(f"select '{c}' as column, count(*) as n_values, count(*) - count({c}) as n_nulls, cast(min({c}) as double) as low, cast(max({c}) as double) as high from lineitem"
                       for c in _NUMBERS))


def _sorted_copy(i):
    """Rows in a range, and row groups a scan for it reads, of the events stored in order of their time."""
    path = _path(i, "in-order")
    i.events.repartitionByRange(8, "ts").sortWithinPartitions("ts").write.parquet(path)
    feet = footers.parquet_footers(i.spark, [path])
    day = lambda n: n * 86_400_000_000
    return footers.groups_to_read(feet, "ts", low=day(19737), high=day(19739)).join(footers.file_skew(feet).select("folder", "files"), "folder").select(
        "rows", (F.col("read_groups") < F.col("row_groups")).alias("skips"), (F.col("read_rows") < F.col("rows")).alias("fewer_rows"))


add("l08_groups_to_read", _sorted_copy, "select count(*) as rows, true as skips, true as fewer_rows from events")


def _sketched(i):
    """Users per event type: days' sketches, stored, merged over a span and held against the exact count."""
    path = _path(i, "sketches")
    days = tables.create_table_as(sketches.daily_sketches(i.events, "user_id", "ts", keys=["event_type"]), path)
    span = sketches.merged_distinct(days, keys=["event_type"], start="2024-01-05", end="2024-01-20")
    inside = i.events.where("cast(ts as date) between date '2024-01-05' and date '2024-01-20'")
    exact = inside.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))
    close = F.abs(F.col("n_distinct") - F.col("n_users")) <= F.col("n_users") * 3 * sketches.relative_error()
    return span.join(exact, "event_type").select("event_type", "n", "n_users", close.alias("within_error"))


add("a02_merged_sketches", _sketched, """
    select event_type, count(*) as n, count(distinct user_id) as n_users, true as within_error from events
    where cast(ts as date) between date '2024-01-05' and date '2024-01-20' group by 1""")


# ---- streaming variants: the bound log is stored as files, then read as a stream
def _streamed(i, log, build):
    path = _path(i, "stream")
    log.write.mode("overwrite").parquet(path + "-in")
    return trends.run_to_table(build(trends.log_stream(i.spark, path + "-in", log.schema)), path + "-out", path + "-state")


def _closed(log, ts):
    """The log and a row two days later without any other value, which closes all windows of the stream."""
    return log.unionByName(log.select((F.max(ts) + F.expr("interval 2 days")).alias(ts)), allowMissingColumns=True)


add("stream_queue_trend", lambda i: _streamed(i, _closed(i.queuelog, "service_class_start_time"), lambda s: trends.queue_trend_stream(s, delay="1 hour")), """
    select date_trunc('hour', service_class_start_time) as hour, service_class, count(query) as query_count, cast(sum(total_queue_time) as bigint) as queue_us,
                      cast(sum(total_exec_time) as bigint) as exec_us from $queuelog group by 1, 2""")
add("stream_connection_pairs", lambda i: _streamed(i, i.connlog, trends.connection_pairs_stream))
add("stream_alert_events", lambda i: _streamed(i, i.alertlog, lambda s: trends.alert_events_stream(s, delay="3000 days")),
    "select distinct query, trim(split_part(event, ':', 1)) as kind from $alertlog")
