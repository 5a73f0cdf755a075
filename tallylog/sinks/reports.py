"""Report sinks (K4, K5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.plans.scratch import scratch_dir

# The sections of a JSON report in order, with how each opens and closes.
_SECTIONS = ("summary", "level_counts", "group_counts", "numeric_stats", "top_ips", "top_errors")


def _json_text(value: Column) -> Column:
    text = F.to_json(F.array(value))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def report_fragments(report: DataFrame) -> DataFrame:
    """The report as one JSON object (K4) in pieces: ``section``, ``at``, ``name``, ``json``, a row per figure.

    In the order of the first three columns the pieces, end to end, are the object; empty sections are left out. Counts
    and rankings are listed largest first, whether or not they were cut. No task holds more than its share of the pieces.
    """
    facet, key, n = F.col("facet"), F.col("key"), F.col("n")
    grouped = facet.startswith("group:")
    section = (
        F.when(facet.isin("summary", "first_timestamp", "last_timestamp"), 0)
        .when(facet == "level", 1)
        .when(grouped, 2)
        .when(facet == "number", 3)
        .when(facet == "ip", 4)
        .when(facet == "error", 5)
    )
    label = F.when(facet == "summary", key).otherwise(facet)
    at = (
        F.when(facet == "number", 0)
        .when(section > 0, -n)
        .when(label == "matched_entries", 0)
        .when(label == "total_entries", 1)
        .when(label == "first_timestamp", 2)
        .otherwise(3)
    )
    stats = F.to_json(F.struct(n.alias("count"), "min", "max", "sum", "avg"))
    named = F.concat(_json_text(key), F.lit(":"))
    piece = (
        F.when(facet == "summary", F.concat(named, n.cast("string")))
        .when(section == 0, F.concat(_json_text(facet), F.lit(":"), _json_text(key)))
        .when(section <= 2, F.concat(named, n.cast("string")))
        .when(section == 3, F.concat(named, stats))
        .otherwise(F.to_json(F.struct(key.alias("value"), n.alias("count"))))
    )
    # a total of 0 is left out
    counted = report.where(~((facet == "summary") & (key == "total_entries") & (n == 0)))
    pieces = counted.select(section.alias("section"), at.cast("long").alias("at"), key.alias("name"), piece.alias("piece"), F.when(grouped, F.substring(facet, 7, 2147483647)).alias("group"))
    place = F.struct("at", "name")
    # six rows at most: where each section begins and ends, and which of them comes first and last
    edges = pieces.groupBy("section").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    ends = edges.agg(F.min("section").alias("head"), F.max("section").alias("tail"))
    marked = pieces.join(F.broadcast(edges), "section").crossJoin(F.broadcast(ends))
    names = F.array(*map(F.lit, _SECTIONS))
    opening = F.concat(
        F.when(F.col("section") == F.col("head"), F.lit("{")).otherwise(F.lit(",")),
        F.lit('"'), F.get(names, F.col("section")), F.lit('":'),
        F.when(F.col("section") >= 4, F.lit("[")).otherwise(F.lit("{")),
        F.when(F.col("section") == 2, F.concat(_json_text(F.col("group")), F.lit(":{"))).otherwise(F.lit("")),
    )
    closing = F.concat(
        F.when(F.col("section") == 2, F.lit("}}")).when(F.col("section") >= 4, F.lit("]")).otherwise(F.lit("}")),
        F.when(F.col("section") == F.col("tail"), F.lit("}")).otherwise(F.lit("")),
    )
    before = F.when(place == F.col("first"), opening).otherwise(F.lit(","))
    after = F.when(place == F.col("last"), closing).otherwise(F.lit(""))
    return marked.select("section", "at", "name", F.concat(before, "piece", after).alias("json"))


def write_report_json(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the report as one JSON object of any size: the part files, in order of name, are the object.

    The report is written once and read from there, since its sections' ends are looked up before its rows are sorted.
    """
    spark = report.sparkSession
    rows = scratch_dir(spark, "report-rows")
    report.write.parquet(rows)
    fragments = report_fragments(spark.read.schema(report.schema).parquet(rows))
    fragments.orderBy("section", "at", "name").select("json").write.mode(mode).text(path)


def write_report_rows(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the long-form report as JSON lines, of any size."""
    report.write.mode(mode).json(path)


def write_report_csv(report: DataFrame, path: str, mode: str = "errorifexists") -> list[str]:
    """Write one CSV directory per non-empty section: level, group, ip, error (K5).

    Returns the sections written. The report is kept while its sections are written, so that the logs
    are scanned once; lost pieces are recomputed.
    """
    sections = (
        ("level", F.col("facet") == "level", "level", "count"),
        ("group", F.col("facet").startswith("group:"), None, "count"),
        ("ip", F.col("facet") == "ip", "ip", "requests"),
        ("error", F.col("facet") == "error", "error", "count"),
    )
    kept = report.persist()
    written = []
    try:
        for name, condition, key_name, count_name in sections:
            rows = kept.where(condition)
            first = rows.select("facet").head()
            if first is None:
                continue
            label = key_name or first["facet"].removeprefix("group:")
            ordered = rows.orderBy(F.col("rank"), F.col("n").desc(), F.col("key"))
            table = ordered.select(F.col("key").alias(label), F.col("n").alias(count_name))
            table.write.mode(mode).csv(f"{path}/{name}", header=True, escape='"')
            written.append(name)
    finally:
        kept.unpersist()
    return written
