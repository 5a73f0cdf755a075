"""Aggregations over entries, one DataFrame each (A1 to A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.functions.fields import entry_field, folded_keys, lookup_field
from tallylog.functions.levels import display_rank
from tallylog.functions.text import absent_if_empty, fence
from tallylog.functions.timestamps import iso_utc
from tallylog.model import ADDRESS_FIELDS, ERROR_KEY_LENGTH, ERROR_LEVELS

# Fixed value: texts that count as numbers (finite decimals).
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """Value of a decimal text; NULL when it is not one or is too large for a double."""
    value = F.when(text.rlike(_DECIMAL), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def address(folded: Column | None = None) -> Column:
    """Client address of an entry: the first non-empty address field."""
    return F.coalesce(*[absent_if_empty(lookup_field(F.col("fields"), name, folded)) for name in ADDRESS_FIELDS])


def error_key() -> Column:
    """Grouping key of an error entry: its message, cut (A7, P13); NULL for other levels."""
    text = F.coalesce(F.col("message"), F.col("raw"))
    cut = F.when(
        F.length(text) > ERROR_KEY_LENGTH, F.concat(F.substring(text, 1, ERROR_KEY_LENGTH), F.lit("..."))
    ).otherwise(text)
    return F.when(F.col("level").isin(*ERROR_LEVELS), cut)


def summary(entries: DataFrame, predicate: Column | None = None) -> DataFrame:
    """One row: total and matched entries, first and last timestamp of the matched (A1, A2, A4)."""
    matched = F.lit(True) if predicate is None else predicate
    time = F.when(matched, F.col("timestamp"))
    return entries.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(matched).alias("matched_entries"),
        iso_utc(F.min(time)).alias("first_timestamp"),
        iso_utc(F.max(time)).alias("last_timestamp"),
    )


def count_by(entries: DataFrame, key: Column, name: str = "value") -> DataFrame:
    """Entries per value of a key, absent and empty values skipped."""
    keyed = fence(entries.select(absent_if_empty(key).alias(name)), name).where(F.col(name).isNotNull())
    return keyed.groupBy(name).agg(F.count(F.lit(1)).alias("count"))


def level_counts(entries: DataFrame) -> DataFrame:
    """Entries per level, most severe first (A3, A10)."""
    return count_by(entries, F.col("level"), "level").orderBy(display_rank(F.col("level")).desc(), "level")


def group_counts(entries: DataFrame, field: str) -> DataFrame:
    """Entries per value of a named column or field (A5)."""
    return count_by(entries, entry_field(field))


def top_n(counts: DataFrame, n: int) -> DataFrame:
    """The n largest counts, ties by value; all of them when n is not positive."""
    ordered = counts.orderBy(F.col("count").desc(), F.col("value"))
    return ordered.limit(n) if n > 0 else ordered


def top_addresses(entries: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent client addresses."""
    keyed = entries.select("fields", folded_keys(F.col("fields")).alias("folded"))
    return top_n(count_by(keyed, address(F.col("folded"))), n)


def top_errors(entries: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent error messages."""
    return top_n(count_by(entries, error_key()), n)


def numeric_stats(entries: DataFrame) -> DataFrame:
    """Count, minimum, maximum, sum and average of every field with numeric values."""
    values = entries.select(F.explode("fields").alias("field", "text"))
    numbers = values.select("field", number(F.col("text")).alias("number")).where(F.col("number").isNotNull())
    return numbers.groupBy("field").agg(
        F.count("number").alias("count"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.sum("number").alias("sum"),
        F.avg("number").alias("avg"),
    )
