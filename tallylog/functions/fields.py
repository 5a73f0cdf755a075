"""Lookups in the dynamic ``fields`` map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallylog.model import FILTER_NAMED_COLUMNS, NAMED_COLUMNS

def folded_keys(fields: Column) -> Column:
    """Lower-cased keys in map order, or NULL when every key is already lower case."""
    keys = F.map_keys(fields)
    joined = F.array_join(keys, ",")
    return F.when(F.lower(joined) != joined, F.transform(keys, F.lower))


def pick_value(fields: Column, folded: Column, name: str) -> Column:
    """Value under ``name``: the exact key first, else the first key equal ignoring case.

    A key that is not found has position 0, and ``get`` returns NULL for an index out of range. Kept this
    short because a decoder repeats it for every known key, and the JVM does not compile long methods.
    """
    position = F.array_position(folded, F.lit(name)).cast("int")
    return F.coalesce(fields[name], F.get(F.map_values(fields), position - 1))


def lookup_field(fields: Column, name: str, folded: Column | None = None) -> Column:
    """Case-insensitive lookup of one key; NULL when absent. Pass ``folded`` to look up many keys."""
    return pick_value(fields, folded_keys(fields) if folded is None else folded, name.lower())


def entry_field(name: str, for_filter: bool = False, folded: Column | None = None) -> Column:
    """A named entry column, or the map value of that name; NULL when absent."""
    key = name.lower()
    columns = FILTER_NAMED_COLUMNS if for_filter else NAMED_COLUMNS
    if key in columns:
        return F.col(columns[key])
    return lookup_field(F.col("fields"), key, folded)
