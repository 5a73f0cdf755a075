"""Line scan and line numbering."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallylog.sources.decode import CSV_OPTIONS, csv_schema

_ROW_IN_PARTITION = (1 << 33) - 1


def scan_position() -> list[Column]:
    """File and position of each scanned row, taken from the scan itself.

    ``block`` is the offset of the input split in its file and ``seq`` counts the rows of the task, so
    (block, seq) orders the rows of a file without a shuffle. The row counter is the low part of
    ``monotonically_increasing_id``; it must be taken before any filter.
    """
    seq = F.monotonically_increasing_id().bitwiseAND(_ROW_IN_PARTITION)
    return [
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), seq.alias("seq")).alias("pos"),
    ]


def choose_files(pattern: str = "", modified_from: dt.datetime | None = None, modified_to: dt.datetime | None = None) -> Column | None:
    """A condition on the files of a scan: a regular expression on the path, and when they were last written (both inclusive).

    It names metadata of the scan alone, so Spark drops the other files from the scan before any task opens them.
    """
    tests = [F.col("_metadata.file_path").rlike(pattern)] if pattern else []
    for moment, later in ((modified_from, True), (modified_to, False)):
        if moment is None:
            continue
        if moment.tzinfo is None:
            raise ValueError("a modification time needs a time zone")
        micros = (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
        written, bound = F.col("_metadata.file_modification_time"), F.timestamp_micros(F.lit(micros))
        tests.append(written >= bound if later else written <= bound)
    return reduce(and_, tests) if tests else None


def of_chosen_files(scanned: DataFrame, on_file: Column | None) -> DataFrame:
    return scanned if on_file is None else scanned.where(on_file)


def read_lines(spark: SparkSession, paths: str | list[str], on_file: Column | None = None) -> DataFrame:
    """All physical lines: ``file``, ``pos``, ``value``. Paths may be files, directories or globs.

    Lines end at a line feed, and one carriage return before it is dropped. ``on_file`` chooses among the files.
    """
    scanned = of_chosen_files(spark.read.option("lineSep", "\n").text(paths), on_file)
    return scanned.select(*scan_position(), _without_carriage_return().alias("value"))


def files_bound(files_per_trigger: int) -> dict[str, str]:
    """The option that bounds the files of a batch; none for 0."""
    return {"maxFilesPerTrigger": str(files_per_trigger)} if files_per_trigger > 0 else {}


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 0) -> DataFrame:
    """Lines of files that arrive in a directory, as a stream: ``file``, ``value``, ``modified``."""
    stream = spark.readStream.option("lineSep", "\n").options(**files_bound(files_per_trigger)).text(path)
    return stream.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        _without_carriage_return().alias("value"),
    )


def _without_carriage_return() -> Column:
    value = F.col("value")
    return F.when(value.endswith("\r"), F.substr(value, F.lit(1), F.length(value) - 1)).otherwise(value)


def read_records(
    spark: SparkSession, paths: str | list[str], header: list[str], multiline: bool = False, on_file: Column | None = None
) -> DataFrame:
    """Records of CSV files that share a header, without the header: place columns and ``_c0``, ``_c1``, ..."""
    reader = spark.read.options(**CSV_OPTIONS).options(header="true", enforceSchema="true")
    # The width of a record is only checked when all of it is parsed, whatever columns a query reads.
    reader = reader.option("columnPruning", "false")
    records = reader.schema(csv_schema(header)).csv(paths, multiLine=multiline)
    values = [name for name in records.columns if name != "_rejected"]
    # Spark refuses a scan of the rejected column alone, as a plain count would ask for.
    always = F.coalesce(F.length(values[0]), F.lit(0)) >= 0
    records = of_chosen_files(records, on_file)
    return records.select(*scan_position(), *values, F.when(always, F.col("_rejected")).alias("_rejected"))


def block_offsets(rows: DataFrame, first_number: int = 1) -> DataFrame:
    """Per input split: the first ``seq`` and the number of its first row.

    One small row per split leaves the counting scan; the running sum over the splits of a file then
    sees only those rows.
    """
    counts = rows.groupBy("file", F.col("pos.block").alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min("pos.seq").alias("first_seq")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0)) + first_number
    return counts.select("file", "block", "first_seq", first.alias("first_number"))


def number_rows(entries: DataFrame, offsets: DataFrame) -> DataFrame:
    """Fill ``line`` from the offsets of the splits. The result is in no order: sort it after numbering.

    Filters should come first: only the rows kept are joined. The offsets have one row per split; whether they are
    broadcast is decided at run time, by their size.
    """
    columns = entries.columns
    small = offsets.withColumnRenamed("file", "_file")
    same_split = (F.col("file") == F.col("_file")) & (F.col("pos.block") == F.col("block"))
    line = F.col("first_number") + F.col("pos.seq") - F.col("first_seq")
    joined = entries.drop("line").join(small, same_split, "left").withColumn("line", line)
    return joined.select(*columns)
