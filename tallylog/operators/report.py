"""The full report: every aggregation from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.functions.fields import entry_field, folded_keys
from tallylog.functions.text import absent_if_empty, fence
from tallylog.functions.timestamps import iso_utc
from tallylog.operators.aggregates import address, error_key, number

REPORT_COLUMNS = ("facet", "key", "rank", "n", "min", "max", "sum", "avg")


def report(
    entries: DataFrame,
    predicate: Column | None = None,
    group_by: str = "",
    top_ips: int = 0,
    top_errors: int = 10,
) -> DataFrame:
    """Long-form report with one row per figure.

    Facets: ``summary`` (keys total_entries, matched_entries), ``first_timestamp`` and ``last_timestamp``
    (the time is the key), ``level``, ``group:<field>``, ``ip`` (only when ``top_ips`` is positive),
    ``error``, and ``number`` (statistics of numeric fields). ``rank`` is set for facets cut to their
    first n. All of it is one scan, one shuffle of partial aggregates, and one of the results by rank.
    """
    totals = facet_totals(entries, predicate, group_by.lower(), top_ips > 0)
    return with_summary_rows(rank_facets(totals, {"ip": top_ips, "error": top_errors}))


def facet_totals(entries: DataFrame, predicate: Column | None, group_by: str, with_ips: bool) -> DataFrame:
    """Partial figures per (facet, key).

    Each entry becomes the array [entry itself, level, group, address, error, field 1, field 2, ...],
    exploded with positions: the leading positions name the facet, the rest are map entries as they are.
    """
    matched = F.lit(True) if predicate is None else predicate
    facets: list[tuple[str, Column]] = [("summary", F.lit("")), ("level", F.col("level"))]
    if group_by:
        facets.append((f"group:{group_by}", absent_if_empty(entry_field(group_by, folded=F.col("folded")))))
    if with_ips:
        facets.append(("ip", address(F.col("folded"))))
    facets.append(("error", error_key()))

    kept = entries.select("timestamp", "level", "source", "message", "raw", "fields", matched.alias("matched"))
    kept = kept.withColumn("folded", folded_keys(F.col("fields")))

    def pair(place: int, key: Column, value: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), key.alias("key"), value.alias("value"))

    itself = F.array(pair(0, F.lit(""), F.lit("")))
    # what an entry lacks goes before it becomes a row
    pairs = F.array_compact(F.array(*(F.when(value.isNotNull(), pair(k, F.lit(""), value)) for k, (_, value) in enumerate(facets[1:], start=1))))
    numbers = F.filter(F.map_entries("fields"), lambda e: number(e["value"]).isNotNull())
    numbers = F.transform(numbers, lambda e: pair(len(facets), e["key"], e["value"]))
    no_items = F.array().cast("array<struct<place:int,key:string,value:string>>")
    items = F.when(F.col("matched"), F.concat(itself, pairs, F.coalesce(numbers, no_items))).otherwise(itself)
    exploded = kept.select(
        "matched",
        F.when(F.col("matched"), F.unix_micros("timestamp")).alias("micros"),
        F.explode(items).alias("item"),
    )
    place, text = F.col("item.place"), F.col("item.value")
    facet = F.when(place == 0, facets[0][0])
    for position, (name, _) in enumerate(facets[1:], start=1):
        facet = facet.when(place == position, name)
    figure = F.when(place >= len(facets), number(text))
    figures = exploded.select(
        facet.otherwise("number").alias("facet"),
        F.when(place >= len(facets), F.col("item.key")).otherwise(text).alias("key"),
        F.when(place == 0, F.col("matched").cast("int")).alias("matched"),
        F.when(place == 0, F.col("micros")).alias("micros"),
        figure.alias("figure"),
    )
    useful = F.when(F.col("facet") == "number", F.col("figure").isNotNull()).otherwise(F.col("key").isNotNull())
    return (
        figures.where(useful)
        .groupBy("facet", "key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("matched").alias("matched"),
            F.min("micros").alias("first"),
            F.max("micros").alias("last"),
            F.min("figure").alias("min"),
            F.max("figure").alias("max"),
            F.sum("figure").alias("sum"),
        )
    )


def rank_facets(totals: DataFrame, bounds: dict[str, int]) -> DataFrame:
    """Cut the bounded facets to their first rows; all other facets pass as they are, without a window.

    Both branches read the same exchange: the fence keeps their filters above the aggregation.
    """
    bounds = {facet: n for facet, n in bounds.items() if n > 0}
    unranked = F.lit(None).cast("int").alias("rank")
    if not bounds:
        return totals.select("*", unranked)
    totals = fence(totals, "facet")
    bounded = F.col("facet").isin(*bounds)
    bound = F.element_at(F.create_map(*(F.lit(part) for pair in bounds.items() for part in pair)), F.col("facet"))
    order = [F.col("n").desc(), F.col("key")]
    # slices of the keys are cut in parallel first, as many as shuffles have partitions
    slices = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = Window.partitionBy("facet", F.pmod(F.xxhash64("key"), F.lit(slices))).orderBy(*order)
    cut = totals.where(bounded).withColumn("rank", F.row_number().over(sliced)).where(F.col("rank") <= bound).drop("rank")
    whole = Window.partitionBy("facet").orderBy(*order)
    cut = cut.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= bound)
    return totals.where(~bounded).select("*", unranked).unionByName(cut)


def with_summary_rows(ranked: DataFrame) -> DataFrame:
    """Turn the summary row into counts and times, and drop the figures that a facet lacks."""
    is_summary, is_number = F.col("facet") == "summary", F.col("facet") == "number"

    def row(facet: Column, key: Column, n: Column) -> Column:
        return F.struct(facet.alias("facet"), key.alias("key"), n.alias("n"))

    def time(micros: str) -> Column:
        return iso_utc(F.timestamp_micros(F.col(micros)))

    none = F.lit(None).cast("bigint")
    rows = F.when(
        is_summary,
        F.array(
            row(F.col("facet"), F.lit("total_entries"), F.col("n")),
            row(F.col("facet"), F.lit("matched_entries"), F.col("matched")),
            row(F.lit("first_timestamp"), time("first"), none),
            row(F.lit("last_timestamp"), time("last"), none),
        ),
    ).otherwise(F.array(row(F.col("facet"), F.col("key"), F.col("n"))))
    unfolded = ranked.select(
        F.inline(rows),
        "rank",
        F.when(is_number, F.col("min")).alias("min"),
        F.when(is_number, F.col("max")).alias("max"),
        F.when(is_number, F.col("sum")).alias("sum"),
        F.when(is_number, F.col("sum") / F.col("n")).alias("avg"),
    )
    return unfolded.where(F.col("key").isNotNull()).select(*REPORT_COLUMNS)
