"""Level names: normalisation (P1), syslog severities (P5), ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallylog.functions.text import trim_space
from tallylog.model import (
    LEVEL_DISPLAY_RANK,
    LEVEL_FILTER_RANK,
    LEVEL_SPELLINGS,
    SYSLOG_SEVERITIES,
)


def level_name(level: Column) -> Column:
    """Trimmed and upper-cased: the form :func:`canonical_level` takes."""
    return F.upper(trim_space(level))


def canonical_level(name: Column) -> Column:
    """Canonical level of an upper-case name; unknown names are kept.

    Kept apart from :func:`level_name` so that a caller can project the name first; it is read several
    times here.
    """
    result = None
    for canonical, spellings in LEVEL_SPELLINGS.items():
        condition = name.isin(*spellings)
        result = F.when(condition, canonical) if result is None else result.when(condition, canonical)
    return result.otherwise(name)


def normalize_level(level: Column) -> Column:
    """Canonical upper-case level; unknown names are kept, upper-cased. NULL stays NULL."""
    return canonical_level(level_name(level))


def normalize_level_name(level: str) -> str:
    """The same rule for a driver-side argument."""
    name = level.strip().upper()
    for canonical, spellings in LEVEL_SPELLINGS.items():
        if name in spellings:
            return canonical
    return name


def severity_level(severity: Column) -> Column:
    """Level of a syslog severity number 0 to 7."""
    names = F.array(*[F.lit(normalize_level_name(name)) for name in SYSLOG_SEVERITIES])
    return F.try_element_at(names, severity + 1)


def _rank(level: Column, ranks: dict[str, int]) -> Column:
    result = None
    for name, rank in ranks.items():
        result = F.when(level == name, rank) if result is None else result.when(level == name, rank)
    return result


def filter_rank(level: Column) -> Column:
    """Rank used by minimum-level filters; NULL for unknown levels."""
    return _rank(level, LEVEL_FILTER_RANK)


def display_rank(level: Column) -> Column:
    """Rank used to order level counts, most severe highest; -1 for unknown levels."""
    return F.coalesce(_rank(level, LEVEL_DISPLAY_RANK), F.lit(-1))
