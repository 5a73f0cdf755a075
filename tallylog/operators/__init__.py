"""Operators: filters, aggregations, the report, order and limits."""

from tallylog.operators.aggregates import (
    group_counts,
    level_counts,
    numeric_stats,
    summary,
    top_addresses,
    top_errors,
    top_n,
)
from tallylog.operators.filters import (
    EntryFilter,
    all_of,
    build_filter,
    field_filter,
    keyword_filter,
    level_filter,
    raw_filter,
    time_filter,
)
from tallylog.operators.limits import head, in_file_order, tail
from tallylog.operators.report import report

__all__ = [
    "EntryFilter",
    "all_of",
    "build_filter",
    "field_filter",
    "group_counts",
    "head",
    "in_file_order",
    "keyword_filter",
    "level_counts",
    "level_filter",
    "numeric_stats",
    "raw_filter",
    "report",
    "summary",
    "tail",
    "time_filter",
    "top_addresses",
    "top_errors",
    "top_n",
]
