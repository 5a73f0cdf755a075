"""The entry data model shared by every decoder, operator and sink."""

from __future__ import annotations

from pyspark.sql import types as T

POSITION_TYPE = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)

# One row per log line, whatever its format. Absent or empty level, source and message are NULL;
# values inside ``fields`` keep the empty string. ``pos`` orders the rows of one file without
# numbering them; ``line`` is filled by ``LogSource.number``.
ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("pos", POSITION_TYPE),
        T.StructField("line", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("raw", T.StringType()),
        T.StructField("parse_error", T.StringType()),
    ]
)
ENTRY_COLUMNS = ENTRY_SCHEMA.fieldNames()

# Format names and their accepted spellings.
FORMATS = ("json", "text", "csv", "syslog")
FORMAT_NAMES = {
    "auto": "auto",
    "": "auto",
    "json": "json",
    "text": "text",
    "plain": "text",
    "txt": "text",
    "csv": "csv",
    "syslog": "syslog",
}

# JSON keys that feed each entry column, in priority order, any letter case.
JSON_ALIASES = {
    "timestamp": ("timestamp", "time", "ts", "t", "@timestamp"),
    "level": ("level", "severity", "lvl", "loglevel"),
    "message": ("message", "msg", "text"),
    "source": ("source", "service", "hostname", "host", "app"),
}

# CSV headers that feed each entry column; the leftmost matching header wins.
CSV_ALIASES = {
    "timestamp": ("timestamp", "time", "ts", "date", "datetime", "@timestamp"),
    "level": ("level", "severity", "loglevel", "lvl"),
    "message": ("message", "msg", "text", "description"),
    "source": ("source", "service", "host", "hostname", "app"),
}

# Entry columns reachable by name in group-by and in field filters.
NAMED_COLUMNS = {
    "level": "level",
    "severity": "level",
    "message": "message",
    "msg": "message",
    "source": "source",
    "service": "source",
    "host": "source",
}
FILTER_NAMED_COLUMNS = {**NAMED_COLUMNS, "hostname": "source"}

# Level spellings that differ from their canonical name.
LEVEL_SPELLINGS = {
    "TRACE": ("TRC",),
    "DEBUG": ("DBG", "DEBU"),
    "INFO": ("INF", "INFORMATION"),
    "WARN": ("WRN", "WARNING"),
    "ERROR": ("ERR",),
    "FATAL": ("FTL", "CRITICAL", "CRIT"),
}

# Rank for minimum-level filters, and rank for displaying level counts.
LEVEL_FILTER_RANK = {"TRACE": 0, "DEBUG": 1, "INFO": 2, "WARN": 3, "ERROR": 4, "FATAL": 5, "PANIC": 6}
LEVEL_DISPLAY_RANK = {"TRACE": 0, "DEBUG": 1, "INFO": 2, "WARN": 3, "ERROR": 4, "PANIC": 5, "FATAL": 6}
DEFAULT_FILTER_RANK = 2

# Levels whose messages count as errors, address fields in lookup order, key length.
ERROR_LEVELS = ("ERROR", "FATAL", "PANIC")
ADDRESS_FIELDS = ("ip", "client_ip", "remote_addr")
ERROR_KEY_LENGTH = 100

# Syslog severity names 0 to 7.
SYSLOG_SEVERITIES = ("EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG")

# Texts of ``parse_error``.
BAD_JSON = "line is not a JSON object"
BAD_SYSLOG = "line has no syslog shape"
BAD_CSV = "wrong number of fields"
