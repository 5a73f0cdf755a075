"""Predicates over entries (F1 to F9). Every function returns a boolean column, never NULL."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.fields import lookup_field
from tallylog.functions.levels import filter_rank, normalize_level_name
from tallylog.model import DEFAULT_FILTER_RANK, FILTER_NAMED_COLUMNS, LEVEL_FILTER_RANK

_JOINERS = ("\x00", "\x01", "\n")
_RFC3339 = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})")


def _check_pattern(pattern: str) -> None:
    """Fail early on a pattern the JVM rejects."""
    session = SparkSession.active()
    try:
        session.sql("SELECT '' RLIKE :pattern", args={"pattern": pattern}).collect()
    except Exception as error:
        raise ValueError(f"Java cannot compile the pattern {pattern!r}") from error


def _true_if(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def keyword_filter(keyword: str) -> Column:
    """Case-insensitive substring of the raw line, message, level, source or any field value (F1)."""
    needle = keyword.lower()
    # Field values are joined by a character the keyword lacks, so that no match spans two values.
    joiner = next((c for c in _JOINERS if c not in needle), None)
    if joiner is None:
        in_fields = F.exists(F.map_values("fields"), lambda value: F.lower(value).contains(needle))
    else:
        in_fields = F.lower(F.array_join(F.map_values("fields"), joiner)).contains(needle)
    tests = [F.lower(F.col(name)).contains(needle) for name in ("raw", "message", "level", "source")]
    return reduce(lambda a, b: a | b, [_true_if(test) for test in [*tests, in_fields]])


def field_filter(expression: str) -> Column:
    """``field:regex``, unanchored and case-sensitive, on a named column or a field (F2).

    An absent level, message or source is matched as the empty string; an absent field never matches.
    """
    name, colon, pattern = expression.partition(":")
    if not colon:
        raise ValueError(f"no colon between field and pattern in {expression!r}")
    name, pattern = name.strip().lower(), pattern.strip()
    _check_pattern(pattern)
    if name in FILTER_NAMED_COLUMNS:
        return F.coalesce(F.col(FILTER_NAMED_COLUMNS[name]), F.lit("")).rlike(pattern)
    return _true_if(lookup_field(F.col("fields"), name).rlike(pattern))


def level_filter(level: str, exact: bool = True) -> Column:
    """Exactly this level, or this level and above (F3, F4). Entries without a level never match."""
    target = normalize_level_name(level)
    if exact:
        return _true_if(F.col("level") == target)
    return _true_if(filter_rank(F.col("level")) >= LEVEL_FILTER_RANK.get(target, DEFAULT_FILTER_RANK))


def raw_filter(pattern: str) -> Column:
    """Unanchored regular expression on the raw line."""
    _check_pattern(pattern)
    return F.col("raw").rlike(pattern)


def _instant(text: str, name: str) -> Column:
    if not _RFC3339.fullmatch(text):
        raise ValueError(f"{text!r} as the {name} time is not of the form 2024-01-31T08:00:00Z")
    try:
        moment = dt.datetime.fromisoformat(text)
    except ValueError as error:
        raise ValueError(f"{text!r} as the {name} time is not of the form 2024-01-31T08:00:00Z") from error
    micros = (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def time_filter(time_from: str = "", time_to: str = "") -> Column:
    """Inclusive time range, either end open (F6). Entries without a timestamp never match."""
    timestamp = F.col("timestamp")
    tests = [timestamp.isNotNull()]
    if time_from:
        tests.append(timestamp >= _instant(time_from, "from"))
    if time_to:
        tests.append(timestamp <= _instant(time_to, "to"))
    return _true_if(all_of(tests))


def all_of(predicates: Sequence[Column]) -> Column:
    """All predicates hold; no predicates accept everything."""
    return reduce(and_, predicates) if predicates else F.lit(True)


@dataclass(frozen=True)
class EntryFilter:
    """A filter in two parts: on the raw line, usable before decoding, and on decoded entries."""

    on_raw: Column | None = None
    on_entry: Column | None = None

    @property
    def is_empty(self) -> bool:
        return self.on_raw is None and self.on_entry is None

    @property
    def predicate(self) -> Column:
        return all_of([part for part in (self.on_entry, self.on_raw) if part is not None])


def build_filter(
    search: str = "",
    filters: Sequence[str] = (),
    level: str = "",
    regex: str = "",
    time_from: str = "",
    time_to: str = "",
    where: Column | None = None,
) -> EntryFilter:
    """Combine the given conditions with AND (F8); empty arguments are skipped.

    The cheap tests come first. ``where`` adds a condition of the caller's own. Raises ``ValueError`` on
    a malformed field filter, regular expression or time.
    """
    tests = []
    if level:
        tests.append(level_filter(level))
    if time_from or time_to:
        tests.append(time_filter(time_from, time_to))
    if where is not None:
        tests.append(_true_if(where))
    tests.extend(field_filter(expression) for expression in filters)
    if search:
        tests.append(keyword_filter(search))
    return EntryFilter(raw_filter(regex) if regex else None, all_of(tests) if tests else None)
