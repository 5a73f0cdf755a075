"""Jobs: the questions a user asks of a log source."""

from tallylog.plans.jobs import ExportResult, aggregate, analyze, export, select_entries, stats, tail_logs
from tallylog.plans.scratch import scratch_dir

__all__ = [
    "ExportResult",
    "aggregate",
    "analyze",
    "export",
    "scratch_dir",
    "select_entries",
    "stats",
    "tail_logs",
]
