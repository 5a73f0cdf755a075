"""Lines appended to files that are known already, as a stream (T1): a streaming source of Spark's Python interface.

The offset of a file is the place behind its last line feed, so a line that is still being written is held back until it
ends. With it goes a checksum of the file's first bytes: a file that is shorter than its offset, or begins otherwise, was
truncated or replaced and is read from its start again. A batch reads the bytes between two offsets, cut into ranges that
tasks read at the same time; it is the same when it is repeated, as long as the bytes behind it stay as they are.
"""

from __future__ import annotations

import fnmatch
import posixpath
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tallylog.sources.ranges import RANGE_BYTES, as_lines, open_file, range_batches

_HEAD_BYTES = 256
_STEP = 1 << 16

#: Per file: the place behind the last whole line, the checksum of the first bytes, and how many those are.
Place = list[int]


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    stop: int


def _checksum(system: pafs.FileSystem, path: str, size: int) -> int:
    with system.open_input_file(path) as source:
        return zlib.crc32(source.read(size))


def _last_line_end(system: pafs.FileSystem, path: str, size: int) -> int:
    """The place behind the last line feed among the first ``size`` bytes; 0 without one."""
    with system.open_input_file(path) as source:
        stop = size
        while stop > 0:
            start = max(0, stop - _STEP)
            source.seek(start)
            feed = source.read(stop - start).rfind(b"\n")
            if feed >= 0:
                return start + feed + 1
            stop = start
    return 0


class AppendedReader(DataSourceStreamReader):
    def __init__(self, path: str, from_end: bool):
        self.path, self.from_end = path, from_end
        self._seen: dict[str, tuple[int, int, Place]] = {}  # size, time of change, what was found

    def _files(self) -> list[tuple[str, pafs.FileSystem, pafs.FileInfo]]:
        system, path = open_file(self.path)
        scheme = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        folder, pattern = path, None
        info = system.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            folder, pattern = posixpath.split(path)
        if info.type == pafs.FileType.File:
            found = [info]
        else:
            found = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return [
            (scheme + each.path, system, each)
            for each in found
            if each.type == pafs.FileType.File and each.base_name[:1] not in "._" and (pattern is None or fnmatch.fnmatch(each.base_name, pattern))
        ]

    def _places(self) -> dict[str, Place]:
        out = {}
        for file, system, info in self._files():
            known = self._seen.get(file)
            if known is None or known[:2] != (info.size, info.mtime_ns):
                end = _last_line_end(system, info.path, info.size)
                head = min(end, _HEAD_BYTES)
                known = info.size, info.mtime_ns, [end, _checksum(system, info.path, head), head]
            out[file] = known[2]
            self._seen[file] = known
        return out

    def initialOffset(self) -> dict:
        return {"files": self._places() if self.from_end else {}}

    def latestOffset(self) -> dict:
        return {"files": self._places()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for file, (stop, _, _) in sorted(end["files"].items()):
            begin, checksum, head = start["files"].get(file, (0, 0, 0))
            if begin > stop or (begin and self._begins_otherwise(file, checksum, head)):
                begin = 0
            for at in range(begin, stop, RANGE_BYTES):
                out.append(_Range(file, at, min(stop, at + RANGE_BYTES)))
        return out

    @staticmethod
    def _begins_otherwise(file: str, checksum: int, head: int) -> bool:
        return _checksum(*open_file(file), head) != checksum

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        yield from range_batches(partition.file, partition.start, partition.stop)


class AppendedLines(DataSource):
    """Options: ``path`` (a file, a directory or a pattern for names in one) and ``fromEnd``."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, block bigint, seq bigint, value binary"

    def streamReader(self, schema) -> AppendedReader:
        return AppendedReader(self.options["path"], self.options.get("fromend", "true") == "true")


def appended_lines(spark: SparkSession, path: str, from_end: bool = True) -> DataFrame:
    """A stream of the lines of ``path`` (``file``, ``pos``, ``value``): those written from now on, or all with ``from_end`` False."""
    spark.dataSource.register(AppendedLines)
    stream = spark.readStream.format("appended_lines").option("path", path).option("fromEnd", str(from_end).lower())
    return as_lines(stream.load())
