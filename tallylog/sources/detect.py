"""Format recognition."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.text import trim_space
from tallylog.functions.timestamps import MONTHS
from tallylog.model import FORMAT_NAMES
from tallylog.sources.lines import of_chosen_files, scan_position
from tallylog.sources.ranges import COMPRESSED, file_sizes, is_compressed, open_file, seekable

# Fixed value: number of leading lines looked at.
SAMPLE_LINES = 10

# Split size of the probe: larger files are split, and only their first split is looked at.
_WHOLE_FILE = str(1 << 40)

#: Files whose beginnings one task reads.
FILES_PER_TASK = 256
_OPEN_COST = 1 << 36
_CHUNK = 1 << 14


def parse_format(name: str) -> str:
    """Canonical format name; ``ValueError`` when unknown."""
    key = name.strip().lower()
    if key not in FORMAT_NAMES:
        raise ValueError(f"unsupported log format {name!r} (supported: auto, json, text, csv, syslog)")
    return FORMAT_NAMES[key]


def listed_files(spark: SparkSession, paths: str | list[str], on_file: Column | None = None) -> list[str]:
    """All files that ``paths`` stand for, as the scan names them (URL-encoded). The driver's file index holds them already."""
    if on_file is not None:
        return sorted(row["file"] for row in file_sizes(_packing(spark), paths, on_file).select("file").collect())
    # the index writes file:///x where the scan writes file:/x
    return sorted(re.sub(r"^(\w+):///", r"\1:/", file) for file in spark.read.text(paths).inputFiles())


def literal_path(file: str) -> str:
    """A file named by a scan as a path to read: decoded, and free of pattern characters."""
    scheme, colon, rest = file.partition(":")
    path = unquote(rest if colon and scheme.isalnum() else file)
    plain = re.sub(r"([\\\[\]{}*?])", r"\\\1", path)
    return f"{scheme}:{plain}" if colon and scheme.isalnum() else plain


def detect_formats(lines: DataFrame) -> DataFrame:
    """Format of each file from its first lines.

    ``lines`` has ``file``, ``line`` (1-based) and ``value``. The result has ``file``, ``format`` and
    ``first_line``, the first line that is not blank. Only the leading lines are shuffled, at most ten
    per file, as counters. A file whose first lines are all blank is text, and has no first line.
    """
    text = trim_space(F.col("value"))
    head = lines.where(F.col("line") <= SAMPLE_LINES).select("file", "line", F.nullif(text, F.lit("")).alias("text"))
    commas = F.length("text") - F.length(F.translate("text", ",", ""))
    syslog_start = F.col("text").rlike("^(?:<|" + "|".join(MONTHS) + ")")
    facts = head.groupBy("file").agg(
        F.count("text").alias("n"),
        F.count_if(F.col("text").startswith("{")).alias("objects"),
        F.count_if(syslog_start).alias("syslogs"),
        F.min(commas).alias("fewest_commas"),
        F.max(commas).alias("most_commas"),
        F.min_by("text", F.when(F.col("text").isNotNull(), F.col("line"))).alias("first_line"),
    )
    half = F.floor(F.col("n") / 2)
    same_commas = (F.col("fewest_commas") >= 2) & (F.col("fewest_commas") == F.col("most_commas"))
    fmt = (
        F.when(F.col("objects") > half, "json")
        .when(same_commas & ~F.col("first_line").startswith("<"), "csv")
        .when(F.col("syslogs") > half, "syslog")
        .otherwise("text")
    )
    return facts.select("file", fmt.alias("format"), "first_line")


def file_heads(spark: SparkSession, paths: str | list[str], files: list[str], on_file: Column | None = None) -> DataFrame:
    """The leading lines of every file: ``file``, ``line``, ``value``. ``files`` is what ``paths`` (and ``on_file``) stand for.

    Tasks hold FILES_PER_TASK paths each and read the beginning of one file after the other, no more of it than its first
    lines take. Compressed files, and stores that Arrow cannot open, go through a scan that stops early.
    """
    plain = [file for file in files if not is_compressed(file)]
    if not plain or not seekable(plain[0]):
        return _scanned_heads(spark, paths, on_file)
    listed = file_sizes(_packing(spark), paths, on_file).where("size > 0")
    read = listed.where(~_named_compressed()).select("file").mapInArrow(_heads, "file string, line bigint, value binary")
    heads = read.select("file", "line", F.col("value").cast("string").alias("value"))
    if len(plain) == len(files):
        return heads
    odd = _scanned_heads(spark, [literal_path(file) for file in files if is_compressed(file)])
    return heads.unionByName(odd)


def _named_compressed() -> Column:
    return F.lower("file").rlike("(" + "|".join(COMPRESSED).replace(".", r"\.") + ")$")


def first_lines(file: str, n: int = SAMPLE_LINES) -> list[bytes]:
    """The first n lines of a file, read in chunks until they are whole."""
    system, path = open_file(file)
    data, feeds = [], 0
    with system.open_input_stream(path) as source:
        while feeds < n:
            chunk = source.read(_CHUNK)
            if not chunk:
                break
            data.append(chunk)
            feeds += chunk.count(b"\n")
    lines = b"".join(data).split(b"\n", n)
    # what follows the n-th line, or the empty rest behind the last line feed
    return lines[:n] if len(lines) > n or lines[-1] else lines[:-1]


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "line", "value"]
    for batch in batches:
        for file in batch.column(0).to_pylist():
            lines = first_lines(file)
            columns = [pa.array([file] * len(lines), pa.string()), pa.array(range(1, len(lines) + 1), pa.int64()), pa.array(lines, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)


def _sibling(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session with the settings of the caller's but these, so that the caller's are left alone."""
    probe = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            probe.conf.set(key, value)
    # with this bound the packing of files would depend on it
    probe.conf.unset("spark.sql.files.maxPartitionNum")
    for key, value in settings.items():
        probe.conf.set(key, value)
    return probe


def _packing(spark: SparkSession) -> SparkSession:
    """A session whose scans pack files by number: a file counts for its open cost, whatever its size."""
    return _sibling(spark, {"spark.sql.files.maxPartitionBytes": str(FILES_PER_TASK * _OPEN_COST), "spark.sql.files.openCostInBytes": str(_OPEN_COST)})


def _scanned_heads(spark: SparkSession, paths: str | list[str], on_file: Column | None = None) -> DataFrame:
    """The leading lines of files of any kind, by a scan.

    Each task takes one small batch and stops, so a file of any size costs one buffered read. The split size and open cost
    give every file a task of its own, and the batch size is the sample size.
    """
    settings = {
        "spark.sql.files.maxPartitionBytes": _WHOLE_FILE,
        "spark.sql.files.openCostInBytes": _WHOLE_FILE,
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(SAMPLE_LINES),
    }
    lines = of_chosen_files(_sibling(spark, settings).read.option("lineSep", "\n").text(paths), on_file)
    placed = lines.select(*scan_position(), "value")
    located = placed.select("file", F.col("pos.block").alias("block"), (F.col("pos.seq") + 1).alias("line"), "value")
    # Local, so that tasks need not import this package.
    first_batch = lambda batches: islice(batches, 1)
    heads = located.mapInArrow(first_batch, "file string, block bigint, line bigint, value string")
    return heads.where(F.col("block") == 0).select("file", "line", "value")
