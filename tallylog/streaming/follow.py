"""Follow arriving log files (T1) and running counts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallylog.functions.fields import entry_field
from tallylog.functions.text import absent_if_empty, non_blank
from tallylog.operators.filters import build_filter
from tallylog.operators.report import facet_totals, rank_facets, with_summary_rows
from tallylog.plans.scratch import scratch_dir
from tallylog.sources.decode import CSV_OPTIONS, csv_entries, csv_schema, decode
from tallylog.sources.detect import parse_format
from tallylog.sources.lines import files_bound, stream_lines
from tallylog.streaming.appended import appended_lines


def follow(
    spark: SparkSession,
    path: str,
    fmt: str,
    search: str = "",
    level: str = "",
    since: dt.datetime | None = None,
    header: list[str] | None = None,
    default_year: int | None = None,
    lines: DataFrame | None = None,
    files_per_trigger: int = 0,
) -> DataFrame:
    """Stream of matching entries from files that appear in a directory.

    The same decoders and predicates as in batch. ``since`` (with a zone) skips files modified before it;
    by default everything present is delivered first. A file is read when it appears, so producers roll
    files; ``lines`` accepts any other stream with a string column ``value``, such as a message topic.
    A stream has no line numbers. CSV needs its ``header``. ``files_per_trigger`` bounds a batch when it is positive.
    """
    name = parse_format(fmt)
    if name == "auto":
        raise ValueError("a stream needs its format: json, text, csv or syslog")
    chosen = build_filter(search=search, level=level)
    if name == "csv" and lines is None:
        if not header:
            raise ValueError("a CSV stream needs its header")
        reader = spark.readStream.options(**CSV_OPTIONS, **files_bound(files_per_trigger)).options(header="true", columnPruning="false").schema(csv_schema(header))
        records = reader.csv(path)
        placed = records.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_modification_time").alias("modified"),
            *records.columns,
        )
        entries = csv_entries(_since(placed, since), header, default_year, keep_rejected=False)
    else:
        arriving = _since(stream_lines(spark, path, files_per_trigger), since) if lines is None else lines
        entries = decode(arriving.where(non_blank(F.col("value"))), name, header, default_year)
    return entries if chosen.on_entry is None else entries.where(chosen.on_entry)


def follow_appended(
    spark: SparkSession,
    path: str,
    fmt: str,
    search: str = "",
    level: str = "",
    from_end: bool = True,
    header: list[str] | None = None,
    default_year: int | None = None,
) -> DataFrame:
    """Stream of matching entries from lines appended to files, known ones and new ones.

    By default it starts at the end of the files that are there. A file that is truncated or replaced is read from its
    start. ``path`` is a file, a directory or a pattern for names, in a store that Arrow opens.
    """
    lines = appended_lines(spark, path, from_end)
    if parse_format(fmt) == "csv":
        # the header is the first line of a file
        lines = lines.where((F.col("pos.block") > 0) | (F.col("pos.seq") > 0))
    return follow(spark, path, fmt, search, level, header=header, default_year=default_year, lines=lines)


def _since(rows: DataFrame, since: dt.datetime | None) -> DataFrame:
    if since is None:
        return rows
    if since.tzinfo is None:
        raise ValueError("since needs a time zone")
    micros = (since - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    return rows.where(F.col("modified") >= F.timestamp_micros(F.lit(micros)))


def running_counts(entries: DataFrame, field: str) -> DataFrame:
    """Running count per value of a column or field; state holds one counter per value."""
    keyed = entries.select(absent_if_empty(entry_field(field)).alias("value")).where(F.col("value").isNotNull())
    return keyed.groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def running_level_counts(entries: DataFrame) -> DataFrame:
    """Running count per level; write it in update or complete mode."""
    return running_counts(entries, "level").withColumnRenamed("value", "level")


def running_report(entries: DataFrame, group_by: str = "", with_ips: bool = False) -> DataFrame:
    """The whole report as a running one, in update or complete mode: levels, group, addresses, errors, numeric
    statistics, counts and first and last time. State is one row per figure, so nothing is ranked or cut.
    """
    totals = facet_totals(entries, None, group_by.lower(), with_ips)
    return with_summary_rows(totals.withColumn("rank", F.lit(None).cast("int"))).drop("rank")


def top_report(
    entries: DataFrame,
    deliver: Callable[[DataFrame, int], None],
    group_by: str = "",
    top_ips: int = 10,
    top_errors: int = 10,
    checkpoint: str | None = None,
    available_now: bool = False,
) -> DataStreamWriter:
    """The batch report as a running one: after every trigger ``deliver(rows, batch number)`` gets the report of all entries
    so far, addresses and errors cut to their first (T2). A bound of 0 leaves addresses out and all errors in, as in batch.

    State is one row per figure, of all keys: one that is not among the first now may be later. Ranks are made from the state
    at each trigger. A trigger that is repeated delivers the same rows again under the same number.
    """
    totals = facet_totals(entries, None, group_by.lower(), top_ips > 0)

    def cut(state: DataFrame, batch: int) -> None:
        # ranked and unranked facets both read it, and the state must be updated once
        state = state.persist()
        try:
            deliver(with_summary_rows(rank_facets(state, {"ip": top_ips, "error": top_errors})), batch)
        finally:
            state.unpersist()

    return start_query(totals, "complete", checkpoint, available_now).foreachBatch(cut)


def start_query(
    entries: DataFrame, mode: str = "append", checkpoint: str | None = None, available_now: bool = False
) -> DataStreamWriter:
    """A writer with a checkpoint in the shared folder; add the sink and start it.

    ``available_now`` processes what is there and stops.
    """
    location = checkpoint or scratch_dir(entries.sparkSession, "stream-checkpoint")
    writer = entries.writeStream.outputMode(mode).option("checkpointLocation", location)
    return writer.trigger(availableNow=True) if available_now else writer
