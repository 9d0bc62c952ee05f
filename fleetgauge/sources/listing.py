"""Files below folders, listed where the work is done: by executors, without reading the files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from ..session import ship_package

_LISTED = "folder string, url string, name string, bytes bigint"


def opened(url: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path there."""
    if "://" not in url and not url.startswith("file:"):
        return fs.LocalFileSystem(), url
    return fs.FileSystem.from_uri(url if "://" in url else url.replace("file:/", "file:///", 1))


def _files(folder: str) -> list[tuple[str, str, str, int]]:
    """The files of a folder and of its subfolders, or the file itself; none if there is neither. Hidden ones are left out."""
    system, path = opened(folder)
    prefix = folder[:folder.index(path)] if path in folder else ""
    itself = system.get_file_info(path)
    if itself.is_file:
        return [(folder, folder, itself.base_name, itself.size)]
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
    inside = lambda info: info.path[len(path.rstrip("/")) + 1:].split("/")
    return [(folder, prefix + info.path, info.base_name, info.size) for info in found
            if info.is_file and not any(part[0] in "._" for part in inside(info))]


def listed(folders: DataFrame, column: str = "folder") -> DataFrame:
    """folder, url, name and bytes of every file below the folders; one task lists a folder, nothing goes to the driver."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                columns = list(zip(*_files(folder))) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))],
                                                 names=["folder", "url", "name", "bytes"])

    ship_package(folders.sparkSession)
    return folders.select(column).distinct().mapInArrow(look, _LISTED)
