"""Sinks for entries and reports."""

from tallylog.sinks.entries import (
    field_keys,
    json_rows,
    listing_lines,
    write_csv,
    write_entries,
    write_json,
    write_parquet,
    write_raw,
)
from tallylog.sinks.reports import report_fragments, write_report_csv, write_report_json, write_report_rows

__all__ = [
    "field_keys",
    "json_rows",
    "listing_lines",
    "report_fragments",
    "write_csv",
    "write_entries",
    "write_json",
    "write_parquet",
    "write_raw",
    "write_report_csv",
    "write_report_json",
    "write_report_rows",
]
