"""Scalar building blocks: every function takes and returns Spark columns."""

from tallylog.functions.fields import entry_field, lookup_field
from tallylog.functions.levels import display_rank, filter_rank, normalize_level, severity_level
from tallylog.functions.text import absent_if_empty, non_blank, trim_space
from tallylog.functions.timestamps import epoch_timestamp, iso_utc, parse_timestamp, syslog_timestamp

__all__ = [
    "absent_if_empty",
    "display_rank",
    "entry_field",
    "epoch_timestamp",
    "filter_rank",
    "iso_utc",
    "lookup_field",
    "non_blank",
    "normalize_level",
    "parse_timestamp",
    "severity_level",
    "syslog_timestamp",
    "trim_space",
]
