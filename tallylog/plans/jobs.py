"""Analyze, aggregate, stats, tail and export over a log source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallylog.operators.filters import EntryFilter, build_filter
from tallylog.operators.limits import head, in_file_order, last_rows
from tallylog.operators.report import report
from tallylog.plans.scratch import written
from tallylog.sinks.entries import EXPORT_FORMATS, write_entries
from tallylog.sources.logs import LogSource


def select_entries(logs: LogSource, chosen: EntryFilter) -> DataFrame:
    """Matching entries. The test on the raw line runs before decoding."""
    entries = logs.entries(raw_filter=chosen.on_raw)
    return entries if chosen.on_entry is None else entries.where(chosen.on_entry)


def analyze(
    logs: LogSource,
    search: str = "",
    filters: Sequence[str] = (),
    level: str = "",
    regex: str = "",
    time_from: str = "",
    time_to: str = "",
    limit: int = 0,
    where: Column | None = None,
    line_numbers: bool = True,
) -> DataFrame:
    """Matching entries, the first ``limit`` in file order when it is positive.

    Line numbers are joined to the rows that remain, and cost one more counting scan. With a limit the result is in
    file order; the sort comes last, since a join keeps none. Files of lines are then read from the first on, in growing
    groups, and no further than the limit needs; CSV, compressed and mixed input is scanned.
    """
    chosen = build_filter(search, filters, level, regex, time_from, time_to, where)
    found = logs.first(limit, chosen.on_raw, chosen.on_entry, line_numbers) if limit > 0 else None
    if found is not None:
        return found[0]
    entries = head(select_entries(logs, chosen), limit)
    if not line_numbers:
        return entries
    return in_file_order(logs.number(entries)) if limit > 0 else logs.number(entries)


def aggregate(
    logs: LogSource,
    search: str = "",
    filters: Sequence[str] = (),
    level: str = "",
    regex: str = "",
    time_from: str = "",
    time_to: str = "",
    group_by: str = "",
    top_ips: int = 0,
    top_errors: int = 0,
    where: Column | None = None,
) -> DataFrame:
    """Report over matching entries; top errors default to 10 when not asked for."""
    chosen = build_filter(search, filters, level, regex, time_from, time_to, where)
    predicate = None if chosen.is_empty else chosen.predicate
    return report(logs.entries(), predicate, group_by, top_ips, top_errors or 10)


def stats(
    logs: LogSource, search: str = "", level: str = "", top_ips: int = 10, top_errors: int = 10
) -> DataFrame:
    """The standard report: top addresses and errors, no grouping. ``top_errors`` 0 lists all errors."""
    chosen = build_filter(search=search, level=level)
    predicate = None if chosen.is_empty else chosen.predicate
    return report(logs.entries(), predicate, "", top_ips, top_errors)


def tail_logs(
    logs: LogSource,
    n: int = 10,
    search: str = "",
    level: str = "",
    filter_first: bool = False,
    line_numbers: bool = False,
) -> DataFrame:
    """The last n non-blank lines of every file, then the filter; or, with ``filter_first``, the last n matches.

    Unless the filter comes first, only the last lines are decoded, and without line numbers only the ends of the files
    are read (CSV and compressed files are scanned).
    """
    chosen = build_filter(search=search, level=level).predicate
    ends = None if filter_first or line_numbers else logs.tail(n)
    if ends is not None:
        return in_file_order(ends.where(chosen))
    if filter_first:
        rows = last_rows(logs.entries().where(chosen), n)
    else:
        rows = logs.entries(last=n).where(chosen)
    return in_file_order(logs.number(rows) if line_numbers else rows)


@dataclass(frozen=True)
class ExportResult:
    """Counts of an export job."""

    exported: int
    total: int
    warnings: int


def export(
    logs: LogSource,
    path: str,
    fmt: str = "json",
    search: str = "",
    filters: Sequence[str] = (),
    level: str = "",
    regex: str = "",
    time_from: str = "",
    time_to: str = "",
    limit: int = 0,
    mode: str = "errorifexists",
    ordered: bool = False,
    where: Column | None = None,
) -> ExportResult:
    """Write matching entries as JSON, CSV or raw lines and return the counts (K6).

    The input is decoded once: that pass writes the matching rows to the scratch folder and counts on the way, in a job
    without shuffles, where a task counts once however often it runs. Everything else works on the rows written. ``ordered``
    sorts the output by file and line, as does a limit; otherwise part files hold the rows as they are read.
    """
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"cannot export as {fmt!r}: choose json, csv or raw")
    chosen = build_filter(search, filters, level, regex, time_from, time_to, where)
    if logs.is_empty():
        raise ValueError("nothing to export: the input holds no line")
    counts = Observation()
    matched = F.col("_matched")
    decoded = logs.entries(keep_rejected=True).withColumn("_matched", ~_is_rejected() & chosen.predicate)
    counted = decoded.observe(
        counts,
        F.count_if(~_is_rejected()).alias("total"),
        F.count_if(F.col("parse_error").isNotNull()).alias("warnings"),
        F.count_if(matched).alias("matched"),
    )
    needed = ["file", "pos", "line", "raw"] if fmt == "raw" else [c for c in decoded.columns if c not in ("raw", "_matched")]
    rows = head(written(counted.where(matched).select(*needed), "export-rows"), limit)
    found = counts.get
    if fmt != "raw":
        rows = logs.number(rows)
    if ordered or limit > 0:
        rows = in_file_order(rows)
    write_entries(rows, path, fmt, mode)
    exported = min(found["matched"], limit) if limit > 0 else found["matched"]
    return ExportResult(exported, found["total"], found["warnings"])


def _is_rejected() -> Column:
    """Rows of the wrong width are warnings, not entries."""
    from tallylog.model import BAD_CSV

    return F.coalesce(F.col("parse_error") == BAD_CSV, F.lit(False))
