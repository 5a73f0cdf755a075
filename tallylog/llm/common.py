"""What the training-data operators share: words, written tables, joins against a checked side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.plans.scratch import scratch_dir

#: Words are runs of anything but space and the controls from tab to carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: A join side is broadcast up to so many rows (of a few numbers each); beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a null, empty or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. ``lower`` does just that unless there is another upper-case letter."""
    upper, plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    other = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(other, F.translate(text, upper, plain)).otherwise(F.lower(text))


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read from there: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows. Give it a written table: the count reads it."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def drop_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ``ids`` (one column, doc_id)."""
    return docs.join(checked(ids), "doc_id", "left_anti")
