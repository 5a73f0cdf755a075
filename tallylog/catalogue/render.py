"""Render rows of the ``events`` table as log lines, inside Spark (rules in FIXTURES.md).

The engine then has to recover from the lines what the table says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_HEADER = ["timestamp", "level", "source", "message", "value", "k", "user_id", "status", "ip"]

_LONG_TAIL = " " + "x" * 100


# Fixed value: rows of a table that one task renders and decodes.
ROWS_PER_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. One of only a few input splits is spread over the cores; larger ones are not moved."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table of narrow rows that become log lines, in tasks of about ``ROWS_PER_TASK`` rows.

    A row group is read by one task whatever number of rows it holds, and a line costs far more to decode than its row to move.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK)))


def facts(events: DataFrame) -> DataFrame:
    """The values that the lines carry."""
    event_id, value, kind = F.col("event_id"), F.col("value"), F.col("event_type")
    wall = F.col("ts").cast("timestamp_ntz").cast("string")
    second = F.concat(F.substring(wall, 1, 10), F.lit("T"), F.substring(wall, 12, 8))
    long_tail = F.when(event_id % 10 == 3, _LONG_TAIL).otherwise("")
    severe = (kind == "error") & (value >= 200)
    address = F.concat(
        F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")
    )
    return events.select(
        "event_id",
        "user_id",
        "value",
        kind.alias("kind"),
        F.col("ts"),
        second.alias("second"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string")).alias("source"),
        F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string"), long_tail).alias("message"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (200 + 100 * (event_id % 4)).cast("int").alias("status"),
        F.when(event_id % 5 != 0, address).alias("address"),
        severe.alias("severe"),
        ((kind == "signup") & (value < 5)).alias("broken"),
    )


def _by_kind(view: str, click: str, signup: str, purchase: str, error: str, severe: str) -> Column:
    kind = F.col("kind")
    return (
        F.when(kind == "view", view)
        .when(kind == "click", click)
        .when(kind == "signup", signup)
        .when(kind == "purchase", purchase)
        .when(F.col("severe"), severe)
        .otherwise(error)
    )


def loose_level() -> Column:
    return _by_kind("dbg", "info", "Information", "wrn", "err", "crit")


def strict_level() -> Column:
    return _by_kind("DEBUG", "INFO", "INFO", "WARNING", "ERROR", "CRITICAL")


def json_value() -> Column:
    """An object; the key spelling varies by row, and broken rows are not objects."""
    style = F.col("event_id") % 3
    stamp = F.concat(F.col("second"), F.lit("Z"))

    def styled(value: Column, *names: str) -> list[Column]:
        return [F.when(style == i, value).alias(name) for i, name in enumerate(names)]

    record = F.struct(
        *styled(stamp, "timestamp", "time", "Ts"),
        *styled(loose_level(), "level", "severity", "LVL"),
        *styled(F.col("message"), "msg", "message", "Text"),
        *styled(F.col("source"), "service", "host", "App"),
        F.col("value"),
        F.col("k"),
        F.col("user_id"),
        F.col("status"),
        *styled(F.col("address"), "ip", "client_ip", "remote_addr"),
    )
    broken = F.concat(F.lit("BROKEN "), F.col("event_id").cast("string"))
    return F.when(F.col("broken"), broken).otherwise(F.to_json(record))


def text_value() -> Column:
    """The five shapes, and one that no shape accepts."""
    shape = F.col("event_id") % 6
    stamp = F.translate("second", "T", " ")
    message, source = F.col("message"), F.col("source")

    def line(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])

    return (
        F.when(shape == 0, line("[", F.col("second"), "Z] [", loose_level(), "] ", message))
        .when(shape == 1, line(stamp, " ", strict_level(), " [", source, "] ", message))
        .when(shape == 2, line(stamp, " - ", loose_level(), " - ", message))
        .when(shape == 3, line(strict_level(), " ", stamp, " ", message))
        .when(shape == 4, line(stamp, " ", message))
        .otherwise(line(F.col("second"), "Z ", strict_level(), " ", message))
    )


def csv_value() -> Column:
    """Data lines for ``CSV_HEADER``; the message needs quoting, and broken rows have a column too many."""
    message = F.concat(F.col("kind"), F.lit(', "by" user '), F.col("user_id").cast("string"))
    record = F.struct(
        F.concat(F.col("second"), F.lit("Z")),
        loose_level(),
        F.col("source"),
        message,
        F.col("value"),
        F.col("k"),
        F.col("user_id"),
        F.col("status"),
        F.col("address"),
    )
    text = F.to_csv(record, {"escape": '"'})
    return F.concat(text, F.when(F.col("broken"), ",extra").otherwise(""))


def syslog_priority() -> Column:
    return _by_kind("15", "14", "14", "12", "11", "10")


def syslog_value() -> Column:
    stamp = F.date_format("ts", "MMM d HH:mm:ss")
    return F.concat(
        F.lit("<"),
        syslog_priority(),
        F.lit(">"),
        stamp,
        F.lit(" "),
        F.col("source"),
        F.lit(" events["),
        F.col("user_id").cast("string"),
        F.lit("]: "),
        F.col("message"),
    )


def lines(rows: DataFrame, value: Column) -> DataFrame:
    """Lines in the form that decoders take; the event id is the line number."""
    return rows.select(F.lit("events").alias("file"), F.col("event_id").alias("line"), value.alias("value"))


def json_lines(rows: DataFrame) -> DataFrame:
    return lines(rows, json_value())


def text_lines(rows: DataFrame) -> DataFrame:
    return lines(rows, text_value())


def csv_lines(rows: DataFrame) -> DataFrame:
    return lines(rows, csv_value())


def syslog_lines(rows: DataFrame) -> DataFrame:
    return lines(rows, syslog_value())
