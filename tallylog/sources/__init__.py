"""Sources: scans, format recognition and decoders."""

from tallylog.sources.decode import decode, decode_csv, decode_json, decode_syslog, decode_text
from tallylog.sources.detect import detect_formats, file_heads, parse_format
from tallylog.sources.lines import read_lines
from tallylog.sources.logs import LogSource, open_logs, parse_warnings, read_logs

__all__ = [
    "LogSource",
    "decode",
    "decode_csv",
    "decode_json",
    "decode_syslog",
    "decode_text",
    "detect_formats",
    "file_heads",
    "open_logs",
    "parse_format",
    "parse_warnings",
    "read_lines",
    "read_logs",
]
