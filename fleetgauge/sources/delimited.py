"""Delimited text: typed reads, rejected values, exports with a manifest, and splitting."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import ship_package
from .listing import listed
from .lines import numbered, records, text_lines

REASON = {T.TimestampNTZType: "Invalid timestamp", T.TimestampType: "Invalid timestamp", T.DateType: "Invalid date", T.BooleanType: "Invalid boolean"}


def _schema(schema) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_delimited(spark: SparkSession, paths, schema, *, sep: str = ",", skip_header: bool = False, null_token: str = "",
                   timestamp_format: str = "yyyy-MM-dd HH:mm:ss[.SSSSSS]", encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """Typed read of delimited files, compressed or not; the schema is declared, never inferred.

    ``multi_line`` allows line breaks inside quoted fields; a big file is still read by many tasks (see ``lines.records``).
    """
    options = {"sep": sep, "nullValue": null_token, "timestampNTZFormat": timestamp_format, "timestampFormat": timestamp_format, "escape": '"'}
    if multi_line:
        found = records(spark, paths, skip_header=skip_header, encoding=encoding)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _schema(schema))
        return found.select(F.from_csv(_unended("value"), ddl, options).alias("r")).select("r.*")
    return spark.read.schema(_schema(schema)).options(**options).option("header", skip_header).option("encoding", encoding).csv(paths)


def _unended(line: str) -> Column:
    """A line without the carriage return that ends it in files of that convention."""
    return F.regexp_replace(line, "\r$", "")


def _cast(c: Column, dtype: T.DataType) -> Column:
    return c.try_cast(dtype)


def read_with_rejects(spark: SparkSession, paths, schema, *, sep: str = ",", skip_header: bool = False, null_token: str = "",
                      multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows whose every value has its declared type, and the values that have not.

    Rejects name the file, the line (from 1, a header counts; of a record over several lines the first), the column, its
    declared type, the raw value, the reason and the raw line as it stands in the file, quotes and all. Both results are lazy
    reads of the files: nothing is dropped or collected. To number the rejects, of every line only its place is
    shuffled; the texts of accepted lines stay where they are.
    """
    schema = _schema(schema)
    text = ", ".join(f"`{f.name}` string" for f in schema) + ", __raw string"
    options = {"sep": sep, "nullValue": null_token, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__raw"}
    value = {f.name: F.col("__r")[f.name] for f in schema}
    corrupt = F.col("__r")["__raw"].isNotNull()
    bad = {f.name: value[f.name].isNotNull() & _cast(value[f.name], f.dataType).isNull() for f in schema}
    none = F.lit(None).cast("string")
    reject = lambda name, kind, raw, reason: F.struct(name.alias("column_name"), kind.alias("column_type"), raw.alias("raw_value"), reason.alias("reason"))
    found = [F.when(corrupt, reject(none, none, none, F.lit("Wrong number of fields")))]
    for f in schema:
        reason = REASON.get(type(f.dataType), "Invalid digit")
        found.append(F.when(~corrupt & bad[f.name], reject(F.lit(f.name), F.lit(f.dataType.simpleString()), value[f.name], F.lit(reason))))

    def judged(lines: DataFrame) -> DataFrame:
        parsed = lines.withColumn("__r", F.from_csv(_unended("value"), text, options))
        return parsed.withColumn("__found", F.filter(F.array(*found), lambda r: r.isNotNull()))

    if multi_line:
        lines = rows = judged(records(spark, paths, skip_header=skip_header))
    else:
        lines = judged(text_lines(spark, paths))
        blank = F.col("value").rlike("^[\\x00-\\x20]*$")      # the reader leaves such lines out
        wanted = (F.size("__found") > 0) & ~blank
        kept = lines.select("__file", "__block", "__place", F.when(wanted, F.col("value")).alias("value"), F.when(wanted, F.col("__found")).alias("__found"))
        rows, lines = lines.where(~blank), numbered(kept)
    lines = lines.where("size(__found) > 0" + (" and line_number > 1" if skip_header else ""))
    rejects = lines.select(F.element_at(F.split("__file", "/"), -1).alias("file_name"), "line_number", F.inline("__found"), F.col("value").alias("raw_line"))
    if skip_header and not multi_line:                      # the reader knows where files begin
        names = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField("__raw", T.StringType())])
        rows = spark.read.schema(names).options(**options).option("header", True).csv(paths).select(F.struct("*").alias("__r"))
        rows = rows.where(~reduce(lambda a, b: a | b, [corrupt, *bad.values()]))
    else:
        rows = rows.where("size(__found) = 0")
    return rows.select(*[_cast(value[f.name], f.dataType).alias(f.name) for f in schema]), rejects


#: Values are written whole: quotes doubled, blanks at either end kept, microseconds kept.
_WRITTEN = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def export_delimited(df: DataFrame, path: str, *, sep: str = "|", gzip: bool = False, header: bool = False, null_token: str = "",
                     order_by: list[str] | None = None, max_rows_per_file: int = 0) -> DataFrame:
    """Parallel export replacing ``path``; returns the manifest of written files.

    ``order_by`` gives one ordered series of files: ranges are written in parallel, file names
    follow the order, and ``max_rows_per_file`` bounds each piece.
    """
    out = df if order_by is None else df.orderBy(*order_by)
    writer = out.write.mode("overwrite").options(**_WRITTEN, sep=sep, nullValue=null_token).option("header", header).option("maxRecordsPerFile", max_rows_per_file)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)
    return manifest_of(df.sparkSession, path)


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with their sizes; executors list them, contents are not read."""
    return listed(spark.createDataFrame([(path,)], "folder string")).select("url", F.lit(True).alias("mandatory"), "bytes")


_PIECES = "piece string, pos bigint, value string"


def export_in_pieces(df: DataFrame, path: str, *, max_bytes: int, order_by: list[str], sep: str = "|", gzip: bool = False, header: bool = False,
                     null_token: str = "") -> DataFrame:
    """One ordered series of delimited files of at most ``max_bytes`` each, replacing ``path``; returns their manifest.

    Sizes count the lines as encoded, with their ends and the header, before compression. A row longer than the limit
    makes a piece of its own. Ranges of the order are dealt to tasks; each task adds up its lines and begins a
    piece where the next line does not fit, so only a range's last piece is short. Rows of equal order are dealt by their
    content and place, so that a value that a third of the rows have is still written by many tasks. The folder
    names of the pieces, ``piece=range-number``, follow the order, as does the manifest's ``piece``.
    """
    columns = df.columns
    options = _WRITTEN | {"sep": sep, "nullValue": null_token}
    first = sep.join(f'"{c}"' if sep in c or '"' in c else c for c in columns) if header else None
    line = F.to_csv(F.struct(*columns), options).alias("value")
    ties = [F.xxhash64(*columns), F.monotonically_increasing_id()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, piece, held, pos = TaskContext.get().partitionId(), -1, max_bytes + 1, 0
        head = 0 if first is None else len(first.encode()) + 1
        for batch in batches:
            sizes = (pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False) + 1).tolist()
            pieces, values = [], []
            for value, size in zip(batch.column(0).to_pylist(), sizes):
                if held + size > max_bytes:
                    piece, held = piece + 1, head
                    if first is not None:
                        pieces.append(piece)
                        values.append(first)
                held += size
                pieces.append(piece)
                values.append(value)
            names = [f"{task:06d}-{p:06d}" for p in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(range(pos, pos + len(values)), pa.int64()), pa.array(values, pa.string())],
                                             names=["piece", "pos", "value"])
            pos += len(values)

    ship_package(df.sparkSession)
    ordered = df.orderBy(*order_by, *ties).select(line)
    lines = ordered.mapInArrow(cut, _PIECES).sortWithinPartitions("piece", "pos").select("piece", "value")
    writer = lines.write.mode("overwrite").partitionBy("piece")
    (writer.option("compression", "gzip") if gzip else writer).text(path)
    return manifest_of(df.sparkSession, path).withColumn("piece", F.regexp_extract("url", "/piece=([0-9-]+)/", 1))


def split_file(spark: SparkSession, source: str, target: str, *, rows_per_piece: int, encoding: str = "UTF-8") -> DataFrame:
    """Cut big text files into pieces of at most ``rows_per_piece`` lines; returns the pieces."""
    spark.read.option("encoding", encoding).text(source).write.mode("overwrite").option("maxRecordsPerFile", rows_per_piece).text(target)
    return manifest_of(spark, target)
