"""Timestamps: parsing of the accepted layouts (P2, P3, P4) and rendering.

Every text is turned into ISO 8601 with an explicit offset before it is cast, so the session time
zone never matters, and the cast parser (hand-written in the JVM, no exceptions on bad input) is used
instead of one formatter per layout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallylog.functions.text import trim_space

# Month names, and the accepted layouts.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
_MONTH = "(?i:" + "|".join(MONTHS) + ")"
_WEEKDAY = "(?i:" + "|".join(_DAY_NAMES) + ")"
_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?"
_ZONE_NAME = r"(?:[A-Z]{3}T?|WITA|[A-Z]{4}T|ChST|MeST)"

_ZONED = rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_CLOCK}(?:Z|[+-]\d{{2}}:\d{{2}})$"
_ZONELESS = rf"^\d{{4}}(?:-\d{{2}}-\d{{2}}[T ]|/\d{{2}}/\d{{2}} ){_CLOCK}$"
_YEARLESS = rf"^{_MONTH} \d{{1,2}} {_CLOCK}$"
_ACCESS_LOG = rf"^(\d{{2}})/({_MONTH})/(\d{{4}}):({_CLOCK}) ([+-]\d{{2}})(\d{{2}})$"
_RUBY_DATE = rf"^{_WEEKDAY} ({_MONTH}) (\d{{2}}) ({_CLOCK}) ([+-]\d{{2}})(\d{{2}}) (\d{{4}})$"
_ANSI_OR_UNIX_DATE = rf"^{_WEEKDAY} ({_MONTH}) (\d{{1,2}}) ({_CLOCK})(?: {_ZONE_NAME})? (\d{{4}})$"
_NUMBER = r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"

_NAMED_MONTH_FORMAT = "yyyy MMM d H:mm:ss[.SSSSSSSSS][,SSSSSSSSS]XXX"


def clean_time(text: Column) -> Column:
    """Trim, and squeeze runs of blanks: the form :func:`parse_clean_time` takes."""
    trimmed = trim_space(text)
    return F.when(trimmed.contains("  "), F.regexp_replace(trimmed, " +", " ")).otherwise(trimmed)


def parse_clean_time(text: Column, default_year: int | None = None) -> Column:
    """Parse a cleaned text in any accepted layout; NULL when none fits. Text without a zone is UTC.

    Kept apart from the cleaning so that a caller can project the cleaned text first; it is read
    several times here.
    """

    def reordered(pattern: str, parts: str) -> Column:
        return F.try_to_timestamp(F.regexp_replace(text, pattern, parts), F.lit(_NAMED_MONTH_FORMAT))

    return (
        F.when(text.rlike(_ZONED), F.translate(text, ",", ".").try_cast("timestamp"))
        .when(text.rlike(_ZONELESS), F.concat(F.translate(text, ",/", ".-"), F.lit("Z")).try_cast("timestamp"))
        .when(text.rlike(_YEARLESS), parse_yearless(text, default_year))
        .when(text.rlike(_ACCESS_LOG), reordered(_ACCESS_LOG, "$3 $2 $1 $4$5:$6"))
        .when(text.rlike(_RUBY_DATE), reordered(_RUBY_DATE, "$6 $1 $2 $3$4:$5"))
        .when(text.rlike(_ANSI_OR_UNIX_DATE), reordered(_ANSI_OR_UNIX_DATE, "$4 $1 $2 $3Z"))
    )


def parse_timestamp(text: Column, default_year: int | None = None) -> Column:
    """Parse any accepted layout (P2). ``default_year`` is for layouts without a year (default: now)."""
    return parse_clean_time(clean_time(text), default_year)


def parse_yearless(text: Column, default_year: int | None = None) -> Column:
    """Parse "Mon d hh:mm:ss", blanks single; NULL when the date does not exist."""
    # the year of the batch, in UTC: a stream that runs over New Year goes along
    now = F.timestamp_add("MICROSECOND", F.unix_micros(F.current_timestamp()), F.lit("1970-01-01").cast("timestamp_ntz"))
    year = F.year(now) if default_year is None else F.lit(default_year)
    # Every third position of the joined names starts a month.
    place = F.position(F.initcap(F.substring(text, 1, 3)), F.lit("".join(MONTHS)))
    month = F.lpad(F.floor((place + 2) / 3).cast("string"), 2, "0")
    date = F.concat(month, F.lit("-"), F.lpad(F.split_part(text, F.lit(" "), F.lit(2)), 2, "0"))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    # 29 February falls on 1 March in a common year.
    date = F.when(leap, date).otherwise(F.replace(date, F.lit("02-29"), F.lit("03-01")))
    clock = F.translate(F.split_part(text, F.lit(" "), F.lit(3)), ",", ".")
    iso = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), date, F.lit("T"), clock, F.lit("Z"))
    return F.when(place % 3 == 1, iso.try_cast("timestamp"))


def syslog_timestamp(text: Column, default_year: int | None = None) -> Column:
    """Parse "Mon d hh:mm:ss" with any white space between the parts."""
    return parse_yearless(F.regexp_replace(text, r"\s+", " "), default_year)


def epoch_timestamp(text: Column) -> Column:
    """Parse decimal epoch seconds with an optional fraction (P3); NULL when not a number."""
    micros = F.round(text.try_cast("double") * 1e6).try_cast("bigint")
    return F.when(text.rlike(_NUMBER), F.timestamp_micros(micros))


def iso_utc(timestamp: Column) -> Column:
    """Render as yyyy-MM-ddTHH:mm:ssZ, whole seconds, whatever the session time zone."""
    wall = F.timestamp_add("MICROSECOND", F.unix_micros(timestamp), F.lit("1970-01-01").cast("timestamp_ntz"))
    # years beyond four digits are written with a sign and as many digits as they need
    date, clock = (F.split_part(wall.cast("string"), F.lit(" "), F.lit(k)) for k in (1, 2))
    return F.concat(date, F.lit("T"), F.substring(clock, 1, 8), F.lit("Z"))
