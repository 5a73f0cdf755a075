"""File order, head and tail (L1 to L3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_file_order(entries: DataFrame) -> DataFrame:
    """Sort by file and position in it (L1). A full sort: ask for it only when order matters."""
    return entries.orderBy("file", "pos", "line")


def head(entries: DataFrame, n: int, ordered: bool = True) -> DataFrame:
    """The first n entries in file order, or any n, which stops the scan early (L2). 0 means all."""
    if n <= 0:
        return entries
    return in_file_order(entries).limit(n) if ordered else entries.limit(n)


def tail(entries: DataFrame, n: int = 10) -> DataFrame:
    """The last n entries of every file, in file order (L3)."""
    return in_file_order(last_rows(entries, n))


def last_rows(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of every file, by ``pos`` and, where there is one, ``line``; not sorted.

    One count per input split tells which splits lie wholly in the tail and which one holds its border. Rows of the
    former pass as they are; only the border split of each file is ranked, so no task ranks a file, and the plan is
    the same for every n.
    """
    order = [F.col(name).desc() for name in ("pos", "line") if name in rows.columns]
    block: Column = F.col("pos.block")
    counts = rows.groupBy("file", block.alias("block")).agg(F.count(F.lit(1)).alias("rows"))
    later = Window.partitionBy("file").orderBy(F.col("block").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    splits = counts.withColumn("_after", F.coalesce(F.sum("rows").over(later), F.lit(0))).where(F.col("_after") < n)
    splits = splits.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "_after", (F.col("_after") + F.col("rows") > n).alias("_border"))
    same = (F.col("file") == F.col("_file")) & block.eqNullSafe(F.col("_block"))
    # a row that is not in a border split is ranked alone
    backwards = Window.partitionBy("file", "_block", F.when(~F.col("_border"), F.col("pos.seq"))).orderBy(*order)
    back = F.when(F.col("_border"), F.row_number().over(backwards) + F.col("_after")).otherwise(F.lit(0))
    return rows.join(splits, same).withColumn("_back", back).where(F.col("_back") <= n).select(*rows.columns)
