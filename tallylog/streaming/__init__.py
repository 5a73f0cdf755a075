"""Continuous processing with Structured Streaming."""

from tallylog.streaming.follow import follow, follow_appended, running_counts, running_level_counts, running_report, start_query, top_report

__all__ = ["follow", "follow_appended", "running_counts", "running_level_counts", "running_report", "start_query", "top_report"]
