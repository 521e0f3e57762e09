"""Folder listings made in tasks.

The driver looks at folders only until there are enough of them to share out; each task walks
its own folders and returns path, length and time of what it finds, in batches.  No list of
files is held by the driver, and a task holds one folder's entries at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "path string, length bigint, modificationTime timestamp"
BATCH_ROWS = 10_000
_TYPES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", tz="UTC"))])


def opened(uri: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what stands before its paths in a full name."""
    system, path = fs.FileSystem.from_uri(uri)
    start = uri[:len(uri) - len(path)] if uri.endswith(path) else uri.split(":", 1)[0] + ":"
    return system, path.rstrip("/") or "/", "file:" if start in ("file:", "file://") else start


def entries(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What is in a folder; none if it is gone."""
    return system.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))


class Folders(InputPartition):
    def __init__(self, folders: list[str], recursive: bool):
        super().__init__(folders)
        self.folders, self.recursive = folders, recursive


class ListingReader(DataSourceReader):
    def __init__(self, uri: str, tasks: int):
        self.uri, self.tasks = uri, tasks

    def partitions(self) -> list[Folders]:
        """Folders one by one, of the first level that has enough; the levels above give only their own files."""
        system, root, _ = opened(self.uri)
        level, above = [root], []
        while level and len(level) < self.tasks:
            below = [e.path for f in level for e in entries(system, f) if e.type == fs.FileType.Directory]
            above += level
            level = below
        shares = [Folders(above[n::self.tasks], False) for n in range(min(self.tasks, len(above)))]
        return shares + [Folders([f], True) for f in level]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        system, _, start = opened(self.uri)
        todo, rows = list(partition.folders), []
        while todo:
            for e in entries(system, todo.pop()):
                if e.type == fs.FileType.Directory:
                    if partition.recursive:
                        todo.append(e.path)
                elif e.type == fs.FileType.File:
                    rows.append((start + e.path, e.size, e.mtime))
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES.types)], schema=_TYPES)


class FolderListing(DataSource):
    """``spark.read.format("folder_listing").option("tasks", n).load(uri)``"""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], int(self.options.get("tasks", "64")))


def full_uri(spark: SparkSession, folder: str) -> str:
    """The folder's name with the session's file system before it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def listed(spark: SparkSession, folder: str) -> DataFrame | None:
    """Files below a folder, hidden ones too; None where only Spark's own readers know the file system."""
    uri = full_uri(spark, folder)
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    try:
        opened(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").option("tasks", max(16, spark.sparkContext.defaultParallelism)).load(uri)
