"""Log sources: one handle over files of any supported format."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.text import non_blank, trim_space
from tallylog.model import BAD_CSV, ENTRY_SCHEMA
from tallylog.operators.limits import head, in_file_order, last_rows
from tallylog.plans.scratch import written
from tallylog.sources.decode import csv_entries, csv_header, decode, decode_csv
from tallylog.sources.detect import detect_formats, file_heads, listed_files, literal_path, parse_format
from tallylog.sources.lines import block_offsets, choose_files, number_rows, read_lines, read_records
from tallylog.sources.records import csv_record_lines
from tallylog.sources.ranges import growing_windows, read_windows, tail_lines, windows_frame


@dataclass(frozen=True)
class Branch:
    """Files decoded the same way."""

    fmt: str
    paths: list[str]
    header: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class LogSource:
    """Log files and how to decode them. Build with :func:`open_logs`."""

    spark: SparkSession
    branches: list[Branch]
    default_year: int | None = None
    multiline_csv: bool = False
    on_file: Column | None = None
    #: Of a source that was decoded once: its entries, rejected ones included, and the number of each split's first line.
    staged: DataFrame | None = None
    offsets: DataFrame | None = None

    def decoded(self) -> LogSource:
        """The same source with its entries decoded once, into the scratch folder: for several jobs over the same files.

        Lines that are added to the files later are not in it.
        """
        if not self.branches:
            return self
        return replace(self, staged=written(self.entries(keep_rejected=True), "decoded"), offsets=written(self._offsets(), "offsets"))

    def entries(
        self, raw_filter: Column | None = None, keep_rejected: bool = False, last: int | None = None
    ) -> DataFrame:
        """All entries, ``line`` still NULL.

        ``raw_filter`` (on ``raw``) is applied before decoding. ``last`` keeps the last lines of every file,
        and only those are decoded.
        """
        if self.staged is not None:
            rows = self.staged if keep_rejected else self.staged.where(~F.col("parse_error").eqNullSafe(BAD_CSV))
            rows = rows if raw_filter is None else rows.where(raw_filter)
            return rows if last is None else last_rows(rows, last)
        parts = [self._branch_entries(branch, raw_filter, keep_rejected, last) for branch in self.branches]
        return self._union(parts) if parts else self.spark.createDataFrame([], ENTRY_SCHEMA)

    def tail(self, n: int) -> DataFrame | None:
        """The last n lines of every file, decoded; only the ends of the files are read. None where that cannot be."""
        parts = []
        for branch in self.branches:
            lines = None if branch.fmt == "csv" else tail_lines(self.spark, branch.paths, n, on_file=self.on_file)
            if lines is None:
                return None
            parts.append(decode(lines, branch.fmt, default_year=self.default_year))
        return self._union(parts) if parts else None

    def first(
        self, n: int, raw_filter: Column | None = None, on_entry: Column | None = None, line_numbers: bool = True
    ) -> tuple[DataFrame, list[tuple[str, int, int]]] | None:
        """The first n matching entries in file order, and the windows of the files that were read for them.

        Files are decoded from the first on, in growing groups, until n matches are in. None where ranges cannot be read.
        """
        if len(self.branches) != 1 or self.branches[0].fmt == "csv":
            return None
        branch = self.branches[0]
        groups = growing_windows(self.spark, branch.paths, on_file=self.on_file)
        if groups is None:
            return None
        kept, used, left = [], [], n
        for group in groups:
            used += group
            lines = read_windows(windows_frame(self.spark, group)).where(non_blank(F.col("value")))
            if raw_filter is not None:
                lines = lines.withColumn("raw", F.col("value")).where(raw_filter).drop("raw")
            entries = decode(lines, branch.fmt, default_year=self.default_year)
            entries = entries if on_entry is None else entries.where(on_entry)
            kept.append(written(head(entries, left), "head"))
            left -= kept[-1].count()
            if left <= 0:
                break
        rows = self._union(kept) if kept else self.spark.createDataFrame([], ENTRY_SCHEMA)
        if line_numbers and used:
            rows = number_rows(rows, block_offsets(read_windows(windows_frame(self.spark, used))))
        return in_file_order(rows), used

    def number(self, entries: DataFrame) -> DataFrame:
        """Fill ``line`` with the line number in the file (for CSV, the record number; the header is 1)."""
        if not self.branches:
            return entries
        return number_rows(entries, self._offsets() if self.offsets is None else self.offsets)

    def _offsets(self) -> DataFrame:
        rows = [self._branch_rows(branch) for branch in self.branches]
        return self._union([block_offsets(r, 2 if b.fmt == "csv" else 1) for r, b in zip(rows, self.branches)])

    def warnings(self) -> DataFrame:
        """Lines that did not decode cleanly, rejected CSV rows included."""
        return self.entries(keep_rejected=True).where(F.col("parse_error").isNotNull())

    def is_empty(self) -> bool:
        return all(self._branch_rows(branch).isEmpty() for branch in self.branches)

    def _branch_rows(self, branch: Branch) -> DataFrame:
        if branch.fmt == "csv":
            lines = csv_record_lines(self.spark, branch.paths, on_file=self.on_file) if self.multiline_csv else None
            if lines is not None:
                return lines
            return read_records(self.spark, branch.paths, branch.header, self.multiline_csv, self.on_file)
        return read_lines(self.spark, branch.paths, self.on_file)

    def _branch_entries(
        self, branch: Branch, raw_filter: Column | None, keep_rejected: bool, last: int | None
    ) -> DataFrame:
        rows = self._branch_rows(branch)
        if branch.fmt == "csv":
            split = csv_entries if "_rejected" in rows.columns else decode_csv
            entries = split(rows, branch.header, self.default_year, keep_rejected)
            entries = entries if raw_filter is None else entries.where(raw_filter)
            return entries if last is None else last_rows(entries, last)
        lines = rows.where(non_blank(F.col("value")))
        if raw_filter is not None:
            lines = lines.withColumn("raw", F.col("value")).where(raw_filter).drop("raw")
        if last is not None:
            lines = last_rows(lines, last)
        return decode(lines, branch.fmt, default_year=self.default_year)

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)


def open_logs(
    spark: SparkSession,
    paths: str | list[str],
    fmt: str = "auto",
    default_year: int | None = None,
    multiline_csv: bool = False,
    files: str = "",
    modified_from: dt.datetime | None = None,
    modified_to: dt.datetime | None = None,
) -> LogSource:
    """Open log files, directories or globs.

    With a known ``fmt`` nothing is read here, except the first line of each CSV file. With ``auto`` the
    first lines of every file are read and each file gets its own format; files decoded alike are then
    scanned together, each once. ``files`` (a regular expression found in the path) and the times of the last
    modification (with a zone, inclusive) choose among the files; the others are never opened.
    """
    name = parse_format(fmt)
    asked = [paths] if isinstance(paths, str) else list(paths)
    on_file = choose_files(files, modified_from, modified_to)
    if name not in ("auto", "csv"):
        return LogSource(spark, [Branch(name, asked)], default_year, multiline_csv, on_file)

    # Every listed file gets a format, whatever its first lines hold; only CSV needs its first line here.
    listed = listed_files(spark, asked, on_file)
    if not listed:
        return LogSource(spark, [], default_year, multiline_csv)
    found = detect_formats(file_heads(spark, asked, listed, on_file))
    chosen = F.col("format") if name == "auto" else F.lit(name)
    rows = found.select("file", chosen.alias("format"), F.when(chosen == "csv", F.col("first_line")).alias("first_line"))
    rows = written(rows, "formats")
    alike = rows.groupBy("format", "first_line").count().limit(2).collect()
    if len(alike) == 1 and alike[0]["count"] == len(listed) and (alike[0]["format"] != "csv" or alike[0]["first_line"]):
        # one row for all files; the paths as given keep the plan small
        header = csv_header(alike[0]["first_line"]) if alike[0]["format"] == "csv" else []
        return LogSource(spark, [Branch(alike[0]["format"], asked, header)], default_year, multiline_csv, on_file)
    formats = {row["file"]: (row["format"], row["first_line"]) for row in rows.collect()}
    unread = "text" if name == "auto" else name
    groups: dict[tuple[str, str | None], list[str]] = defaultdict(list)
    for file in listed:
        groups[formats.get(file, (unread, None))].append(file)
    headless = groups.pop(("csv", None), [])
    for file, first_line in _later_headers(spark, headless).items():
        groups[("csv", first_line)].append(file)
    branches = []
    for (group, first_line), members in sorted(groups.items(), key=lambda item: (item[0][0], item[0][1] or "")):
        paths = asked if len(groups) == 1 else [literal_path(file) for file in sorted(members)]
        branches.append(Branch(group, paths, csv_header(first_line) if group == "csv" else []))
    return LogSource(spark, branches, default_year, multiline_csv, on_file)


def _later_headers(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """The first line that is not blank of CSV files that start with more blank lines than are looked at.

    Files without such a line have neither header nor records.
    """
    if not files:
        return {}
    lines = read_lines(spark, [literal_path(file) for file in files]).where(non_blank(F.col("value")))
    return {row["file"]: row["first_line"] for row in lines.groupBy("file").agg(F.min_by(trim_space(F.col("value")), "pos").alias("first_line")).collect()}


def read_logs(
    spark: SparkSession,
    paths: str | list[str],
    fmt: str = "auto",
    default_year: int | None = None,
    line_numbers: bool = True,
) -> DataFrame:
    """Entries of log files in one call. Without line numbers the input is scanned once."""
    logs = open_logs(spark, paths, fmt, default_year)
    entries = logs.entries()
    return logs.number(entries) if line_numbers else entries


def parse_warnings(entries: DataFrame) -> DataFrame:
    """Rows of a DataFrame of entries that did not decode cleanly."""
    return entries.where(F.col("parse_error").isNotNull())
