"""White space and emptiness rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode white-space characters.
WHITE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_EDGE = r"\A[\s\x{85}\p{Z}]|[\s\x{85}\p{Z}]\z"


def trim_space(text: Column) -> Column:
    """Strip white space of any kind from both ends (Spark's plain trim strips blanks only).

    Most texts have none to strip, and looking is cheaper than stripping.
    """
    return F.when(text.rlike(_EDGE), F.btrim(text, F.lit(WHITE_SPACE))).otherwise(text)


def non_blank(text: Column) -> Column:
    """True when the line holds anything but white space."""
    return text.rlike(r"[^\s\x{85}\p{Z}]")


def absent_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def fence(rows: DataFrame, *names: str) -> DataFrame:
    """Keep later filters above the projection that computes the named columns.

    Catalyst pushes a filter through a projection by copying the projected expressions into it; after a
    decoder that would decode each line once per copy. A projection holding a non-deterministic
    expression is left alone, so each line is decoded once. Columns that nothing reads are still pruned.
    """
    once = {name: F.when(F.spark_partition_id() >= 0, F.col(name)) for name in names}
    return rows.select(*[once[name].alias(name) if name in once else F.col(name) for name in rows.columns])
