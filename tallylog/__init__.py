"""tallylog: log analytics on Spark."""

from tallylog.operators import build_filter, report
from tallylog.plans import ExportResult, aggregate, analyze, export, stats, tail_logs
from tallylog.sources import LogSource, detect_formats, open_logs, parse_warnings, read_logs
from tallylog.streaming import follow, follow_appended

__all__ = [
    "ExportResult",
    "LogSource",
    "aggregate",
    "analyze",
    "build_filter",
    "detect_formats",
    "export",
    "follow",
    "follow_appended",
    "open_logs",
    "parse_warnings",
    "read_logs",
    "report",
    "stats",
    "tail_logs",
]
