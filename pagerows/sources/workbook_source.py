"""A folder of workbooks as a data source: ``spark.read.format("workbooks").load(folder)``.

Files are listed once and dealt into partitions by size, so that large and small ones take about the same time; each is
read where its partition runs. What can't be read is a row with an error, never the end of a job. Folders are those
that pyarrow's file systems reach; for any other that Spark reads there is ``workbooks.read_workbooks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .workbooks import MAX_FILE, read_workbook

SCHEMA = "path string, sheet_no int, sheet string, row_pos int, cells array<string>, error string"
_TYPES = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Bytes of files in a partition, unless one file has more, and what opening a file counts for.
PARTITION_BYTES, OPEN_BYTES = 32 << 20, 256 << 10


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        super().__init__(len(paths))
        self.paths = paths


def groups(files: list[tuple[str, int]], most: int = PARTITION_BYTES) -> list[Files]:
    """Files by falling size, each to the first group with room for it; in the end by name."""
    held: list[list] = []
    room: list[int] = []
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        cost = min(size, MAX_FILE) + OPEN_BYTES
        at = next((k for k in range(max(0, len(room) - 8), len(room)) if room[k] >= cost), None)  # of the last few
        if at is None:
            held.append([])
            room.append(most)
            at = len(room) - 1
        held[at].append((path, size))
        room[at] -= cost
    return [Files(sorted(h)) for h in held]


class WorkbookReader(DataSourceReader):
    """Options: ``path``; ``pattern``, the end of the names that count (``.xlsx``); ``partitionBytes``."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("which folder? load(path)")
        self.folder, self.pattern = options["path"], options.get("pattern", ".xlsx").lower()
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        # an empty folder has one partition without files: Spark reads a source of none as one that doesn't divide
        return groups([(f.path, f.size or 0) for f in found if f.is_file and f.path.lower().endswith(self.pattern)], self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        for path, size in partition.paths:
            none = (path, None, None, None, None)
            if size > MAX_FILE:
                rows = [(*none, "a file has 10 MB at most")]
            else:
                try:
                    with store.open_input_stream(path) as f:
                        rows = [(path, *r, None) for r in read_workbook(f.read())]
                except (OSError, ValueError) as e:
                    rows = [(*none, str(e))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
