"""Decoders: a column of log lines becomes a DataFrame of entries.

Each decoder takes a DataFrame with a string column ``value`` (and, when known, ``file``, ``pos`` and
``line``), works on batch and streaming input alike, and uses column expressions only.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.functions.fields import folded_keys, pick_value
from tallylog.functions.levels import canonical_level, level_name, severity_level
from tallylog.functions.text import absent_if_empty, fence, trim_space
from tallylog.functions.timestamps import clean_time, epoch_timestamp, parse_clean_time, parse_yearless
from tallylog.model import BAD_CSV, BAD_JSON, BAD_SYSLOG, CSV_ALIASES, ENTRY_SCHEMA, JSON_ALIASES

_MAP_TYPE = "map<string,string>"
_PLACE_COLUMNS = ("file", "pos", "line")
_DECODED = ("timestamp", "level", "source", "message", "fields", "raw", "parse_error")


def _place(lines: DataFrame) -> list[Column]:
    """File, position and line number of each row; NULL where the input has none."""
    types = {field.name: field.dataType for field in ENTRY_SCHEMA.fields}
    return [
        F.col(name) if name in lines.columns else F.lit(None).cast(types[name]).alias(name)
        for name in _PLACE_COLUMNS
    ]


def _no_fields() -> Column:
    return F.create_map().cast(_MAP_TYPE)


# --- JSON lines -----------------------------------------------------------------------------------

_JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_BARE_TIME = '(?i)"(?:' + "|".join(JSON_ALIASES["timestamp"]) + r')"\s*:\s*-?\d'
_JSON_KNOWN_KEYS = [key for keys in JSON_ALIASES.values() for key in keys]


def _last_of_repeated_keys(fields: Column) -> Column:
    """An object may repeat a key; the last value counts."""
    keys = F.map_keys(fields)
    entries = F.map_entries(fields)
    last = F.filter(
        entries,
        lambda entry, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), entry["key"]),
    )
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(last)).otherwise(fields)


def decode_json(lines: DataFrame, default_year: int | None = None) -> DataFrame:
    """Decode one JSON object per line; a line that is not an object becomes a message with an error."""
    value = F.col("value")
    trimmed = F.when(value.startswith("{") & value.endswith("}"), value).otherwise(trim_space(value))
    parsed = F.from_json(F.when(trimmed.endswith("}"), trimmed), _MAP_TYPE, _JSON_OPTIONS)
    place = [F.col(name) for name in _PLACE_COLUMNS]
    objects = lines.select(*_place(lines), F.col("value").alias("raw"), parsed.alias("object"))
    objects = objects.select(*place, "raw", _last_of_repeated_keys(F.col("object")).alias("object"))
    keyed = objects.select(*place, "raw", "object", folded_keys(F.col("object")).alias("folded"))

    def present(column: str) -> list[Column]:
        return [pick_value(F.col("object"), F.col("folded"), name) for name in JSON_ALIASES[column]]

    # digits are epoch seconds only as a JSON number; as text they are in none of the layouts
    bare_number = F.col("raw").rlike(_BARE_TIME)

    def instant(clean_text: Column) -> Column:
        return F.coalesce(parse_clean_time(clean_text, default_year), F.when(bare_number, epoch_timestamp(clean_text)))

    picked = keyed.select(
        *place,
        "raw",
        "object",
        F.array_compact(F.array(*present("timestamp"))).alias("times"),
        F.coalesce(*present("level")).alias("level"),
        F.coalesce(*present("source")).alias("source"),
        F.coalesce(*present("message")).alias("message"),
    )
    fields = F.col("object")
    cleaned = picked.select(
        *place,
        "raw",
        "object",
        "times",
        clean_time(F.get("times", F.lit(0))).alias("time"),
        absent_if_empty(level_name(F.col("level"))).alias("level"),
        absent_if_empty(F.col("source")).alias("source"),
        absent_if_empty(F.when(fields.isNull(), F.col("raw")).otherwise(F.col("message"))).alias("message"),
    )
    # The first time key present nearly always parses; only if it does not are the others tried in turn.
    retried = F.array_compact(F.transform("times", lambda text: instant(clean_time(text))))
    timestamp = F.when(F.col("time").isNotNull(), F.coalesce(instant(F.col("time")), F.get(retried, F.lit(0))))
    others = F.map_filter(fields, lambda key, value: ~F.lower(key).isin(*_JSON_KNOWN_KEYS) & value.isNotNull())
    entries = cleaned.select(
        *place,
        timestamp.alias("timestamp"),
        canonical_level(F.col("level")).alias("level"),
        "source",
        "message",
        F.coalesce(others, _no_fields()).alias("fields"),
        "raw",
        F.when(fields.isNull(), F.lit(BAD_JSON)).alias("parse_error"),
    )
    return fence(entries, *_DECODED)


# --- Plain text -----------------------------------------------------------------------------------

# The accepted line shapes in priority order, with the columns their groups feed.
_STAMP = r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]?\d*"
_LEVELS = r"TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|PANIC|CRIT(?:ICAL)?"
TEXT_SHAPES = (
    (r"\[(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\]]*)\]\s*\[(\w+)\]\s*(.*)", ("timestamp", "level", "message")),
    (
        rf"({_STAMP})\s+({_LEVELS})\s+(?:\[([^\]]+)\]\s+)?(.*)",
        ("timestamp", "level", "source", "message"),
    ),
    (rf"({_STAMP})\s+-\s+(\w+)\s+-\s+(.*)", ("timestamp", "level", "message")),
    (rf"({_LEVELS})\s+({_STAMP})\s+(.*)", ("level", "timestamp", "message")),
    (rf"({_STAMP})\s+(.*)", ("timestamp", "message")),
)
_TEXT_COLUMNS = ("timestamp", "level", "source", "message")
_MATCHED = "\x01"


def _text_rewrite() -> tuple[str, str]:
    """One pattern trying the shapes in order, and the rewrite that lines up their groups.

    Only the groups of the shape that matched are non-empty, so joining all groups of a column yields
    its value. No value before the message can hold a closing bracket, which makes it a safe separator.
    """
    pattern = "^(?s:" + "|".join(shape for shape, _ in TEXT_SHAPES) + ")$"
    groups: dict[str, list[str]] = {column: [] for column in _TEXT_COLUMNS}
    number = 0
    for _, columns in TEXT_SHAPES:
        for column in columns:
            number += 1
            groups[column].append(f"${number}")
    return pattern, _MATCHED + "]".join("".join(groups[column]) for column in _TEXT_COLUMNS)


def _split_rewritten(separator: str, n: int) -> Column:
    """Parts of a line that matched its pattern, NULL of one that did not.

    No pattern accepts a line starting with the marker, so a new marker means that the pattern matched.
    """
    rewritten, raw = F.col("rewritten"), F.col("raw")
    matched = rewritten.startswith(_MATCHED) & ~raw.startswith(_MATCHED)
    return F.when(matched, F.split(F.substring(rewritten, 2, 2147483647), separator, n))


def decode_text(lines: DataFrame, default_year: int | None = None) -> DataFrame:
    """Decode plain-text lines by shape; a line of no known shape is all message."""
    pattern, rewrite = _text_rewrite()
    value = F.col("value")
    place = [F.col(name) for name in _PLACE_COLUMNS]
    rewritten = F.regexp_replace(value, F.lit(pattern), F.lit(rewrite))
    tried = lines.select(*_place(lines), value.alias("raw"), rewritten.alias("rewritten"))
    matched = tried.select(*place, "raw", _split_rewritten(r"\]", len(_TEXT_COLUMNS)).alias("parts"))
    part = {name: absent_if_empty(F.get(F.col("parts"), i)) for i, name in enumerate(_TEXT_COLUMNS)}
    message = F.when(F.col("parts").isNull(), F.col("raw")).otherwise(part["message"])
    picked = matched.select(
        *place,
        "raw",
        clean_time(part["timestamp"]).alias("time"),
        level_name(part["level"]).alias("level"),
        part["source"].alias("source"),
        absent_if_empty(message).alias("message"),
    )
    entries = picked.select(
        *place,
        parse_clean_time(F.col("time"), default_year).alias("timestamp"),
        canonical_level(F.col("level")).alias("level"),
        "source",
        "message",
        _no_fields().alias("fields"),
        "raw",
        F.lit(None).cast("string").alias("parse_error"),
    )
    return fence(entries, *_DECODED)


# --- CSV ------------------------------------------------------------------------------------------

CSV_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_rejected",
    "ignoreLeadingWhiteSpace": "true",
    "quote": '"',
    "escape": '"',
    "unescapedQuoteHandling": "STOP_AT_CLOSING_QUOTE",
}


def csv_header(line: str) -> list[str]:
    """Column names of a header line."""
    return next(csv.reader([line], skipinitialspace=True), [])


def csv_schema(header: list[str]) -> str:
    """Reader schema: one positional text column per header, plus the place for rejected rows."""
    return ", ".join([f"_c{i} string" for i in range(len(header))] + ["_rejected string"])


def _leftmost(header: list[str], column: str) -> Column:
    for i, name in enumerate(header):
        if name.strip().lower() in CSV_ALIASES[column]:
            return F.col(f"_c{i}")
    return F.lit(None).cast("string")


def csv_entries(records: DataFrame, header: list[str], default_year: int | None, keep_rejected: bool) -> DataFrame:
    """Entries from split records (``csv_schema`` columns)."""
    values = [F.coalesce(F.col(f"_c{i}"), F.lit("")) for i in range(len(header))]
    rejected = F.col("_rejected")
    last = {name: i for i, name in enumerate(header)}
    pairs = [item for name, i in last.items() for item in (F.lit(name), values[i])]
    good = lambda column: F.when(rejected.isNull(), column)
    named = records.withColumn("time", clean_time(_leftmost(header, "timestamp")))
    named = named.withColumn("level", absent_if_empty(level_name(_leftmost(header, "level"))))
    entries = named.select(
        *_place(records),
        good(parse_clean_time(F.col("time"), default_year)).alias("timestamp"),
        good(canonical_level(F.col("level"))).alias("level"),
        good(absent_if_empty(_leftmost(header, "source"))).alias("source"),
        good(absent_if_empty(_leftmost(header, "message"))).alias("message"),
        F.when(rejected.isNull(), F.create_map(*pairs)).otherwise(_no_fields()).alias("fields"),
        F.coalesce(rejected, F.concat_ws(",", *values)).alias("raw"),
        F.when(rejected.isNotNull(), F.lit(BAD_CSV)).alias("parse_error"),
    )
    entries = fence(entries, *_DECODED)
    return entries if keep_rejected else entries.where(F.col("parse_error").isNull())


def decode_csv(
    lines: DataFrame, header: list[str], default_year: int | None = None, keep_rejected: bool = False
) -> DataFrame:
    """Decode CSV lines (without the header line). Rows of another width are rejected.

    Rejected rows are not entries; ``keep_rejected`` returns them too, with ``parse_error`` set.
    """
    record = F.from_csv(F.col("value"), F.lit(csv_schema(header)), CSV_OPTIONS)
    split = lines.select(*_place(lines), record.alias("record"))
    records = split.select(*[F.col(name) for name in _PLACE_COLUMNS], "record.*")
    return csv_entries(records, header, default_year, keep_rejected)


# --- Syslog ---------------------------------------------------------------------------------------

# Fixed value: priority, time, host, process, process id and message of a BSD syslog line.
SYSLOG_SHAPE = (
    r"^(?s:(?:<(\d{1,3})>)?(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s*(.*))$"
)
# Priority, process id, process and time cannot hold an opening bracket, and the host has no blank.
_SYSLOG_REWRITE = _MATCHED + "$1[$5[$4[$2[$3 $6"


def decode_syslog(lines: DataFrame, default_year: int | None = None) -> DataFrame:
    """Decode BSD syslog lines; a line of another shape becomes a message with an error."""
    value = F.col("value")
    place = [F.col(name) for name in _PLACE_COLUMNS]
    rewritten = F.regexp_replace(value, F.lit(SYSLOG_SHAPE), F.lit(_SYSLOG_REWRITE))
    tried = lines.select(*_place(lines), value.alias("raw"), rewritten.alias("rewritten"))
    matched = tried.select(*place, "raw", _split_rewritten(r"\[", 5).alias("parts"))
    priority, pid, process, time, rest = (F.get(F.col("parts"), i) for i in range(5))
    named = matched.select(
        *place,
        "raw",
        F.col("parts").isNotNull().alias("matched"),
        absent_if_empty(priority).alias("priority"),
        absent_if_empty(pid).alias("pid"),
        trim_space(process).alias("process"),
        F.regexp_replace(time, r"\s+", " ").alias("time"),
        F.substring_index(rest, " ", 1).alias("host"),
        F.substr(rest, F.locate(" ", rest) + 1).alias("message"),
    )
    number = F.col("priority").cast("int")
    severity = number.bitwiseAND(7)
    parsed_fields = {
        "priority": F.col("priority"),
        "facility": F.shiftright(number, 3).cast("string"),
        "severity": severity.cast("string"),
        "hostname": F.col("host"),
        "process": F.col("process"),
        "pid": F.col("pid"),
    }
    pairs = [item for name, value in parsed_fields.items() for item in (F.lit(name), value)]
    fields = F.map_filter(F.create_map(*pairs), lambda name, value: value.isNotNull())
    entries = named.select(
        *place,
        parse_yearless(F.col("time"), default_year).alias("timestamp"),
        severity_level(severity).alias("level"),
        F.col("host").alias("source"),
        absent_if_empty(F.when(F.col("matched"), F.col("message")).otherwise(F.col("raw"))).alias("message"),
        fields.alias("fields"),
        F.col("raw"),
        F.when(~F.col("matched"), F.lit(BAD_SYSLOG)).alias("parse_error"),
    )
    return fence(entries, *_DECODED)


# --- Choice by format -----------------------------------------------------------------------------


def decode(lines: DataFrame, fmt: str, header: list[str] | None = None, default_year: int | None = None) -> DataFrame:
    """Decode lines of a known format."""
    if fmt == "json":
        return decode_json(lines, default_year)
    if fmt == "csv":
        return decode_csv(lines, header or [], default_year)
    if fmt == "syslog":
        return decode_syslog(lines, default_year)
    return decode_text(lines, default_year)
