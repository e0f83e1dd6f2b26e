"""The end of log files as a Spark data source: only the last bytes of each file are read."""

from __future__ import annotations

import posixpath

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: a larger file is read from its last bytes alone, and of what is read the last lines count
WHOLE_BYTES, TAIL_BYTES, TAIL_LINES = 100_000, 50_000, 1_000

SCHEMA = "file string, line_no long, value string"


class _File(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.whole, self.bytes, self.lines = (int(options.get(k, d)) for k, d in (("wholeBytes", WHOLE_BYTES), ("tailBytes", TAIL_BYTES), ("tailLines", TAIL_LINES)))

    def partitions(self) -> list[_File]:
        """One per file; hidden ones and marks of finished writes are no logs."""
        system, at = fs.FileSystem.from_uri(self.path) if "://" in self.path or ":/" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(at)
        found = system.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
        return [_File(f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"]

    def read(self, partition: _File):
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or ":/" in self.path else fs.LocalFileSystem()
        start = partition.size - self.bytes if partition.size > self.whole else 0
        with system.open_input_file(partition.path) as f:
            f.seek(max(0, start - 1))
            data = f.read(partition.size - max(0, start - 1))
        if start > 0:  # what stands before the first end of line is the rest of a line
            data = data.partition(b"\n")[2]
        lines = data.decode("utf-8", "replace").split("\n")
        lines = lines[:-1] if lines and not lines[-1] else lines
        lines = lines[-self.lines :]
        for k, line in enumerate(lines):
            yield posixpath.basename(partition.path), k - len(lines), line.removesuffix("\r")


class TailSource(DataSource):
    """file, line_no (from the end: the last is -1) and value of the last lines of a file or of each file of a folder.

    Options: ``tailLines`` lines at most; a file of more than ``wholeBytes`` bytes is
    read from its last ``tailBytes`` alone, without the line that these cut in two.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tail(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The end of the log files at ``path``."""
    spark.dataSource.register(TailSource)
    return spark.read.format("tail").options(**options).load(path)
