"""Lines of chosen byte ranges: read the end, the beginning or what is new of files, not the whole of them.

A scan reads every split of a file. Here a row per range (file, start, stop) is dealt to tasks instead, and each task opens
the file at the range's start and yields the lines that begin in it. A line belongs to the range that holds its first byte,
so ranges that meet lose and repeat none. Files are opened through Arrow's file systems (local, HDFS, S3, GCS); compressed
files and other stores have no ranges: ``seekable`` tells, and callers scan those.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.text import non_blank
from tallylog.operators.limits import last_rows
from tallylog.plans.scratch import written
from tallylog.sources.lines import of_chosen_files

#: Bytes of a range, at most; a task holds one range and the rest of its last line.
RANGE_BYTES = 8 << 20
#: What is looked at first of a file's end, and how much more each round takes.
FIRST_BYTES = 64 << 10
GROWTH = 4
#: Tasks that ranges are dealt to, at most.
MOST_TASKS = 4096
COMPRESSED = (".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate", ".xz")
_CHUNK = 1 << 16
_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("value", pa.binary())])


def open_file(file: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI as Spark names files, and the path in it."""
    uri = urlparse(file)
    if uri.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(uri.path) if uri.scheme else file
    system, path = pafs.FileSystem.from_uri(file)
    return system, path


def is_compressed(file: str) -> bool:
    return file.lower().endswith(COMPRESSED)


def seekable(file: str) -> bool:
    """Whether ranges of a file can be read."""
    if is_compressed(file):
        return False
    try:
        open_file(file)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def range_lines(file: str, start: int, stop: int) -> list[bytes]:
    """The lines that begin in [start, stop), without their line feeds; the last may end behind the range or with the file."""
    system, path = open_file(file)
    with system.open_input_file(path) as source:
        before = 1 if start else 0
        source.seek(start - before)
        data = source.read(stop - start + before)
        if before:
            # a line begins behind a line feed
            feed = data.find(b"\n")
            data = b"" if feed < 0 else data[feed + 1 :]
        if not data:
            return []
        parts = [data]
        while not parts[-1].endswith(b"\n"):
            more = source.read(_CHUNK)
            if not more:
                break
            feed = more.find(b"\n")
            parts.append(more if feed < 0 else more[: feed + 1])
    lines = b"".join(parts).split(b"\n")
    return lines[:-1] if not lines[-1] else lines


def range_batches(file: str, start: int, stop: int, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    lines = range_lines(file, start, stop)
    for at in range(0, len(lines), rows):
        some = lines[at : at + rows]
        columns = [pa.array([file] * len(some)), pa.array([start] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield from range_batches(row["file"], row["start"], row["stop"])


def as_lines(read: DataFrame) -> DataFrame:
    """``file``, ``pos`` (start of the range, line in it) and ``value``, as a scan gives them."""
    value = F.col("value").cast("string")
    plain = F.when(value.endswith("\r"), F.substr(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    return read.select("file", F.struct("block", "seq").alias("pos"), plain.alias("value"))


def file_sizes(spark: SparkSession, paths: str | list[str], on_file: Column | None = None) -> DataFrame:
    """``file`` and ``size`` of every file, or of the chosen ones, from the listing; nothing is read."""
    listed = of_chosen_files(spark.read.format("binaryFile").load(paths), on_file)
    return listed.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))


def read_windows(windows: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The lines that begin in windows (``file``, ``start``, ``stop``) of any size, as a scan gives them."""
    total = windows.agg(F.sum(F.ceil((F.col("stop") - F.col("start")) / range_bytes))).first()[0] or 1
    ranges = windows.where("start < stop").select(
        "file", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(range_bytes).cast("long"))).alias("start"), F.col("stop").alias("end")
    )
    ranges = ranges.select("file", "start", F.least(F.col("start") + range_bytes, "end").alias("stop"))
    # a row is a range to read: as many tasks as ranges, whatever the size of the rows
    dealt = ranges.repartition(int(min(total, MOST_TASKS)))
    return as_lines(dealt.mapInArrow(_read, "file string, block bigint, seq bigint, value binary"))


def tail_lines(
    spark: SparkSession, paths: str | list[str], n: int, first_bytes: int = FIRST_BYTES, on_file: Column | None = None
) -> DataFrame | None:
    """The last n lines of every file that are not blank; None if a file has no ranges.

    Of each file the last bytes are counted, and of those with too few lines GROWTH times as many, until the window
    holds n lines or the file. So what is read of a file depends on n, not on the file.
    """
    sizes = written(file_sizes(spark, paths, on_file).where("size > 0"), "tail-files")
    some = sizes.select("file").first()
    compressed = F.lower("file").rlike("(" + "|".join(COMPRESSED).replace(".", r"\.") + ")$")
    if some is not None and (not seekable(some["file"]) or not sizes.where(compressed).isEmpty()):
        return None
    done: list[DataFrame] = []
    pending = sizes.select("file", F.greatest(F.lit(0), F.col("size") - first_bytes).alias("start"), F.col("size").alias("stop"))
    while True:
        lines = read_windows(pending).where(non_blank(F.col("value")))
        counts = lines.groupBy(F.col("file").alias("of")).agg(F.count(F.lit(1)).alias("lines"))
        looked = pending.join(counts, F.col("file") == F.col("of"), "left")
        enough = (F.coalesce("lines", F.lit(0)) >= n) | (F.col("start") == 0)
        looked = written(looked.select("file", "start", "stop", enough.alias("enough")), "tail-windows")
        done.append(looked.where("enough").drop("enough"))
        short = looked.where("NOT enough")
        if short.isEmpty():
            break
        wider = F.greatest(F.lit(0), F.col("stop") - GROWTH * (F.col("stop") - F.col("start")))
        pending = short.select("file", wider.alias("start"), "stop")
    windows = done[0]
    for more in done[1:]:
        windows = windows.unionByName(more)
    return last_rows(read_windows(windows).where(non_blank(F.col("value"))), n)


def growing_windows(
    spark: SparkSession, paths: str | list[str], first_bytes: int = 1 << 20, on_file: Column | None = None
) -> Iterator[list[tuple[str, int, int]]] | None:
    """All bytes of all files in file order, as groups of (file, start, stop), each GROWTH times as large as the one before.

    The files are listed as the groups need them. None if a file has no ranges.
    """
    sizes = written(file_sizes(spark, paths, on_file).where("size > 0"), "head-files")
    some = sizes.select("file").first()
    compressed = F.lower("file").rlike("(" + "|".join(COMPRESSED).replace(".", r"\.") + ")$")
    if some is not None and (not seekable(some["file"]) or not sizes.where(compressed).isEmpty()):
        return None

    def groups() -> Iterator[list[tuple[str, int, int]]]:
        budget, held, room = first_bytes, [], first_bytes
        for row in sizes.orderBy("file").toLocalIterator():
            at = 0
            while at < row["size"]:
                stop = min(row["size"], at + room)
                held.append((row["file"], at, stop))
                room -= stop - at
                at = stop
                if room <= 0:
                    yield held
                    budget, held = budget * GROWTH, []
                    room = budget
        if held:
            yield held

    return groups()


def windows_frame(spark: SparkSession, windows: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame(windows, "file string, start long, stop long")
