"""The query catalogue: one entry per operator, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallylog.catalogue import render
from tallylog.functions import iso_utc, normalize_level, parse_timestamp
from tallylog.functions.fields import folded_keys
from tallylog.operators import aggregates, filters, limits
from tallylog.operators.report import report
from tallylog.plans.jobs import analyze, export, stats, tail_logs
from tallylog.plans.scratch import scratch_dir
from tallylog.sinks.entries import listing_lines, write_csv, write_parquet
from tallylog.sinks.reports import write_report_csv, write_report_json
from tallylog.sources.decode import decode_csv, decode_json, decode_syslog, decode_text
from tallylog.sources.detect import detect_formats
from tallylog.sources.lines import read_lines
from tallylog.sources.logs import open_logs
from tallylog.sources.ranges import open_file
from tallylog.sources.records import csv_record_lines
from tallylog.streaming.follow import follow, running_level_counts, running_report, start_query, top_report
from tallylog.streaming.follow import follow_appended as follow_growing

YEAR = 2024


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return render.facts(render.spread_table(spark, sf, "events"))


def json_entries(spark: SparkSession, sf: str) -> DataFrame:
    return decode_json(render.json_lines(_facts(spark, sf)))


def text_entries(spark: SparkSession, sf: str) -> DataFrame:
    return decode_text(render.text_lines(_facts(spark, sf)))


def csv_entries(spark: SparkSession, sf: str, keep_rejected: bool = False) -> DataFrame:
    return decode_csv(render.csv_lines(_facts(spark, sf)), render.CSV_HEADER, keep_rejected=keep_rejected)


def syslog_entries(spark: SparkSession, sf: str) -> DataFrame:
    return decode_syslog(render.syslog_lines(_facts(spark, sf)), YEAR)


def document_entries(spark: SparkSession, sf: str) -> DataFrame:
    documents = render.table(spark, sf, "documents")
    return decode_text(documents.select(F.col("doc_id").alias("line"), F.col("text").alias("value")))


def _field(name: str) -> Column:
    return F.col("fields")[name]


def _columns(entries: DataFrame, *extra: Column) -> DataFrame:
    return entries.select(
        "line", iso_utc(F.col("timestamp")).alias("time"), "level", "source", "message", *extra, "parse_error"
    )


# --- Decoders -------------------------------------------------------------------------------------


def parse_json_entries(spark: SparkSession, sf: str) -> DataFrame:
    entries = json_entries(spark, sf).withColumn("folded", folded_keys(F.col("fields")))
    address = aggregates.address(F.col("folded")).alias("address")
    names = [_field(name).alias(name) for name in ("value", "k", "user_id", "status")]
    return _columns(entries, *names, address, F.size("fields").cast("bigint").alias("n_fields"))


def parse_text_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _columns(text_entries(spark, sf))


def parse_csv_entries(spark: SparkSession, sf: str) -> DataFrame:
    names = [_field(name).alias(f"f_{name}") for name in render.CSV_HEADER if name not in ("timestamp", "message")]
    return _columns(csv_entries(spark, sf), *names)


def parse_syslog_entries(spark: SparkSession, sf: str) -> DataFrame:
    names = ("priority", "facility", "severity", "hostname", "process", "pid")
    return _columns(syslog_entries(spark, sf), *[_field(name).alias(name) for name in names])


def parse_warnings(spark: SparkSession, sf: str) -> DataFrame:
    facts = _facts(spark, sf)
    # No text line is a syslog line: each is a warning for that decoder.
    parts = {
        "json": decode_json(render.json_lines(facts)),
        "csv": decode_csv(render.csv_lines(facts), render.CSV_HEADER, keep_rejected=True),
        "syslog": decode_syslog(render.text_lines(facts), YEAR),
    }
    counts = [
        entries.where(F.col("parse_error").isNotNull())
        .groupBy(F.lit(name).alias("format"), "parse_error")
        .agg(F.count(F.lit(1)).alias("n"))
        for name, entries in parts.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- Format recognition and numbering -------------------------------------------------------------


def detect_format(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's events form a file, in the format user_id % 4."""
    style = F.col("user_id") % 4
    value = (
        F.when(style == 0, render.json_value())
        .when(style == 1, render.text_value())
        .when(style == 2, render.csv_value())
        .otherwise(render.syslog_value())
    )
    order = Window.partitionBy("user_id").orderBy("event_id")
    line = F.row_number().over(order).alias("line")
    placed = _facts(spark, sf).select(F.col("user_id").alias("file"), line, value.alias("value"))
    return detect_formats(placed).select(F.col("file").alias("user_id"), "format")


def detect_format_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is a file."""
    documents = render.table(spark, sf, "documents")
    lines = documents.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "value"))
    found = detect_formats(lines.select("file", (F.col("at") + 1).alias("line"), "value"))
    return found.select(F.col("file").alias("doc_id"), "format", "first_line")


def _write_lines(lines: DataFrame, name: str) -> str:
    path = scratch_dir(lines.sparkSession, name)
    lines.select("value").write.text(path)
    return path


def line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Write the lines as files; the numbers of each file must run from 1 to its number of lines."""
    path = _write_lines(render.text_lines(_facts(spark, sf)), "numbered")
    logs = open_logs(spark, path, "text")
    numbered = logs.number(logs.entries())
    files = numbered.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.min("line").alias("low"), F.max("line").alias("high"), F.sum("line").alias("sum")
    )
    exact = (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("sum") * 2 == F.col("n") * (F.col("n") + 1))
    return files.agg(F.sum("n").alias("lines"), F.sum(F.when(~exact, F.col("n")).otherwise(0)).alias("misnumbered"))


# --- Scalar functions -----------------------------------------------------------------------------


def level_normalize(spark: SparkSession, sf: str) -> DataFrame:
    spelled = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("\t "), F.upper(render.loose_level()), F.lit(" ")))
    name = spelled.otherwise(render.loose_level())
    return _facts(spark, sf).select("event_id", normalize_level(name).alias("level"))


def timestamp_layouts(spark: SparkSession, sf: str) -> DataFrame:
    second, ts = F.col("second"), F.col("ts")
    spaced = F.translate(second, "T", " ")
    layouts = [
        F.concat(second, F.lit("Z")),
        F.concat(second, F.lit(".987654321Z")),
        second,
        spaced,
        F.concat(spaced, F.lit(",250")),
        F.translate(spaced, "-", "/"),
        F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss +0000"),
        F.date_format(ts, "MMM d HH:mm:ss"),
        F.concat(F.lit("Mon "), F.date_format(ts, "MMM d HH:mm:ss yyyy")),
        F.concat(F.lit("Mon "), F.date_format(ts, "MMM dd HH:mm:ss +0000 yyyy")),
    ]
    choice = F.col("event_id") % len(layouts)
    text = None
    for i, layout in enumerate(layouts):
        text = F.when(choice == i, layout) if text is None else text.when(choice == i, layout)
    rendered = _facts(spark, sf).select("event_id", text.alias("text"))
    return rendered.select("event_id", iso_utc(parse_timestamp(F.col("text"), YEAR)).alias("time"))


# --- Filters --------------------------------------------------------------------------------------


def search_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return document_entries(spark, sf).where(filters.keyword_filter("THE")).select("line")


def search_keyword_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Levels are found under their canonical name, which the line itself does not contain."""
    return json_entries(spark, sf).where(filters.keyword_filter("fatal")).select("line", "level")


def filter_field_regex(spark: SparkSession, sf: str) -> DataFrame:
    return json_entries(spark, sf).where(filters.field_filter("Status:^[45]")).select("line", _field("status").alias("status"))


def filter_field_column(spark: SparkSession, sf: str) -> DataFrame:
    """A named column, absent values matched as empty."""
    return text_entries(spark, sf).where(filters.field_filter("level:^$")).select("line", "message")


def filter_level_exact(spark: SparkSession, sf: str) -> DataFrame:
    return json_entries(spark, sf).where(filters.level_filter("err")).select("line", "level", "message")


def filter_level_min(spark: SparkSession, sf: str) -> DataFrame:
    return json_entries(spark, sf).where(filters.level_filter("warn", exact=False)).select("line", "level")


def filter_raw_regex(spark: SparkSession, sf: str) -> DataFrame:
    return document_entries(spark, sf).where(filters.raw_filter(r"[0-9]{3}-[0-9]{4}")).select("line")


def filter_time_range(spark: SparkSession, sf: str) -> DataFrame:
    in_range = filters.time_filter("2024-01-10T00:00:00Z", "2024-01-19T23:30:00-00:30")
    return json_entries(spark, sf).where(in_range).select("line", iso_utc(F.col("timestamp")).alias("time"))


def filter_chain(spark: SparkSession, sf: str) -> DataFrame:
    chosen = filters.build_filter(
        search="USER",
        filters=["source:^svc-[0-4]$", "k:^[1-9][0-9]$"],
        level="error",
        regex=r'"value":[0-9]+\.[0-9]',
        time_from="2024-01-03T00:00:00Z",
        time_to="2024-01-28T00:00:00Z",
    )
    return json_entries(spark, sf).where(chosen.predicate).select("line", "source", _field("k").alias("k"))


# --- Aggregations ---------------------------------------------------------------------------------


def matched_total(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.summary(json_entries(spark, sf), filters.level_filter("ERROR"))


def level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.level_counts(json_entries(spark, sf))


def group_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.group_counts(json_entries(spark, sf), "Service")


def group_by_field(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.group_counts(json_entries(spark, sf), "USER_ID")


def top_ips(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.top_addresses(json_entries(spark, sf), 10)


def top_errors(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.top_errors(text_entries(spark, sf), 25)


def _rounded(stats_rows: DataFrame) -> DataFrame:
    rounded = [F.round(name, 2).alias(name) for name in ("min", "max", "sum", "avg")]
    return stats_rows.select("field", "count", *rounded)


def numeric_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(aggregates.numeric_stats(json_entries(spark, sf)))


def numeric_stats_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem rows as JSON lines; texts among the fields are skipped."""
    items = render.spread_table(spark, sf, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linenumber"]
    lines = items.select(F.to_json(F.struct(*names)).alias("value"))
    return _rounded(aggregates.numeric_stats(decode_json(lines)))


def group_counts_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as JSON lines with their own level names."""
    orders = render.spread_table(spark, sf, "orders")
    record = F.struct(F.col("o_orderpriority").alias("severity"), F.col("o_custkey").alias("customer"))
    entries = decode_json(orders.select(F.to_json(record).alias("value")))
    return aggregates.group_counts(entries, "level")


def full_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = report(json_entries(spark, sf), filters.level_filter("info", exact=False), "source", 5, 15)
    figures = [F.round(name, 2).alias(name) for name in ("min", "max", "sum", "avg")]
    return rows.select("facet", "key", F.col("rank").cast("bigint").alias("rank"), "n", *figures)


def report_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The report over orders as JSON lines, grouped by their unique key, with more errors asked for than are ranked at once."""
    orders = render.spread_table(spark, sf, "orders")
    level = F.when(F.col("o_orderstatus") == "F", "err").when(F.col("o_orderstatus") == "O", "info").otherwise("wrn")
    message = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))
    record = F.struct(level.alias("level"), message.alias("msg"), F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("price"))
    rows = report(decode_json(orders.select(F.to_json(record).alias("value"))), group_by="number", top_errors=150)
    figures = [F.round(name, 2).alias(name) for name in ("min", "max")]
    return rows.select("facet", "key", F.col("rank").cast("bigint").alias("rank"), "n", *figures)


# --- Order and limits -----------------------------------------------------------------------------


def head_limit(spark: SparkSession, sf: str) -> DataFrame:
    matching = json_entries(spark, sf).where(filters.level_filter("FATAL"))
    return limits.head(matching, 20).select("line", "message")


def tail_n(spark: SparkSession, sf: str) -> DataFrame:
    """The last 20 lines of every service, then the filter."""
    entries = syslog_entries(spark, sf).withColumn("file", F.col("source"))
    return limits.tail(entries, 20).where(filters.level_filter("INFO")).select("file", "line")


def tail_large(spark: SparkSession, sf: str) -> DataFrame:
    """A tail beyond the pruned range."""
    entries = syslog_entries(spark, sf).withColumn("file", F.col("source"))
    return limits.tail(entries, 1200).select("file", "line")


def _file_per_source(lines: DataFrame, facts: DataFrame, name: str) -> str:
    """A folder with one file per service, its lines in the order of the events."""
    path = scratch_dir(lines.sparkSession, name)
    rows = lines.select("line", "value").join(facts.select(F.col("event_id").alias("line"), "source"), "line")
    placed = rows.repartition("source").sortWithinPartitions("source", "line")
    placed.select("source", "value").write.partitionBy("source").text(path)
    return path


def _service() -> Column:
    return F.regexp_extract("file", "source=([^/]+)/", 1)


def head_files(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 and the first 5,000 matches over the files in their order, with service and line number."""
    facts = _facts(spark, sf)
    logs = open_logs(spark, _file_per_source(render.json_lines(facts), facts, "head"), "json")
    rows = [analyze(logs, level="WARN", limit=n).select(F.lit(n).alias("n"), _service().alias("service"), "line", "message") for n in (20, 5000)]
    return rows[0].unionByName(rows[1])


def tail_files(spark: SparkSession, sf: str) -> DataFrame:
    """The last 1,200 lines of every file and of those the informative ones, with their place from the end."""
    facts = _facts(spark, sf)
    logs = open_logs(spark, _file_per_source(render.syslog_lines(facts), facts, "tail"), "syslog", default_year=YEAR)
    last = tail_logs(logs, 1200)
    back = F.row_number().over(Window.partitionBy("file").orderBy(F.col("pos").desc()))
    return last.select(_service().alias("service"), back.cast("long").alias("back"), "level", "message").where("level = 'INFO'")


def file_order(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines exported in file order, with the place each has among the lines of its service in the output."""
    facts = _facts(spark, sf)
    logs = open_logs(spark, _file_per_source(render.syslog_lines(facts), facts, "order"), "syslog", default_year=YEAR)
    target = scratch_dir(spark, "export")
    export(logs, target, "raw", level="ERROR", ordered=True)
    back = read_lines(spark, target).select(F.element_at(F.split("file", "/"), -1).alias("part"), "pos", "value")
    service = F.regexp_extract("value", r" (svc-\d+) ", 1)
    place = F.row_number().over(Window.partitionBy(service).orderBy("part", "pos"))
    return back.select(service.alias("service"), place.cast("long").alias("place"), F.col("value").alias("raw"))


# --- Sinks ----------------------------------------------------------------------------------------


def export_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = _write_lines(render.json_lines(_facts(spark, sf)), "logs")
    target = scratch_dir(spark, "export")
    export(open_logs(spark, path), target, "json", level="error")
    schema = "line long, timestamp string, level string, source string, message string, fields map<string,string>"
    written = spark.read.schema(schema).json(target)
    fields = [_field(name).alias(name) for name in ("value", "user_id", "status")]
    return written.select("timestamp", "level", "source", "message", *fields)


def export_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = _write_lines(render.json_lines(_facts(spark, sf)), "logs")
    target = scratch_dir(spark, "export")
    export(open_logs(spark, path, "json"), target, "csv", filters=["status:^5"])
    written = spark.read.csv(target, header=True, escape='"')
    names = ("timestamp", "level", "source", "message", "value", "user_id", "ip", "client_ip", "remote_addr")
    return written.select(*names)


def export_raw_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = _write_lines(render.syslog_lines(_facts(spark, sf)), "logs")
    target = scratch_dir(spark, "export")
    export(open_logs(spark, path, default_year=YEAR), target, "raw", level="ERROR", search="by user 1")
    return spark.read.text(target).select(F.col("value").alias("raw"))


def export_parquet_by_date(spark: SparkSession, sf: str) -> DataFrame:
    target = scratch_dir(spark, "export")
    write_parquet(json_entries(spark, sf), target)
    kept = spark.read.parquet(target).where(F.col("date") == "2024-01-15")
    return kept.select("line", "level", F.col("date").cast("string").alias("date"))


def listing(spark: SparkSession, sf: str) -> DataFrame:
    return listing_lines(json_entries(spark, sf)).select("line", "listing")


def report_object(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON report, written, read back and taken apart."""
    target = scratch_dir(spark, "report")
    write_report_json(report(json_entries(spark, sf), None, "source", 5, 5), target)
    schema = (
        "summary struct<matched_entries:long,total_entries:long,first_timestamp:string,last_timestamp:string>,"
        "level_counts map<string,long>, group_counts map<string,map<string,long>>,"
        "numeric_stats map<string,struct<count:long,min:double,max:double,sum:double,avg:double>>,"
        "top_ips array<struct<value:string,count:long>>, top_errors array<struct<value:string,count:long>>"
    )
    parts = spark.read.text(target, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda p: p["value"]), "").alias("value"))
    parsed = whole.select(F.from_json("value", schema).alias("r")).select("r.*")

    def part(section: str, exploded: Column, key: str, n: str) -> DataFrame:
        return parsed.select(exploded).select(F.lit(section).alias("section"), F.expr(key).alias("key"), F.expr(n).alias("n"))

    parts = [
        parsed.select(F.lit("total").alias("section"), F.lit("").alias("key"), F.col("summary.total_entries").alias("n")),
        part("level", F.explode("level_counts"), "key", "value"),
        part("group", F.explode(F.col("group_counts")["source"]), "key", "value"),
        part("number", F.explode("numeric_stats"), "key", "value.count"),
        part("ip", F.inline("top_ips"), "value", "count"),
        part("error", F.inline("top_errors"), "value", "count"),
    ]
    result = parts[0]
    for other in parts[1:]:
        result = result.unionByName(other)
    return result


def report_csv_sections(spark: SparkSession, sf: str) -> DataFrame:
    target = scratch_dir(spark, "report")
    write_report_csv(report(json_entries(spark, sf), None, "source", 5, 5), target)
    result = None
    sections = (("level", "level", "count"), ("group", "source", "count"), ("ip", "ip", "requests"), ("error", "error", "count"))
    for section, key, n in sections:
        rows = spark.read.csv(f"{target}/{section}", header=True, escape='"')
        rows = rows.select(F.lit(section).alias("section"), F.col(key).alias("key"), F.col(n).cast("bigint").alias("n"))
        result = rows if result is None else result.unionByName(rows)
    return result


# --- Jobs and streams -----------------------------------------------------------------------------


def _headed(lines: DataFrame, beginning: str) -> DataFrame:
    """Lines that become files with the same beginning: the first line of every task follows it."""
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    return lines.select(F.when(first, F.concat(F.lit(beginning), "value")).otherwise(F.col("value")).alias("value"))


def _csv_files(lines: DataFrame, path: str) -> str:
    """Lines of CSV as files that each begin with the header."""
    _headed(lines, ",".join(render.CSV_HEADER) + "\n").write.text(path)
    return path


def csv_multiline_files(spark: SparkSession, sf: str) -> DataFrame:
    """CSV files with line breaks, commas and quotes inside quotes and broken rows, read in small splits; rejected rows too."""
    facts = _facts(spark, sf).withColumn("message", F.concat("message", F.when(F.col("event_id") % 3 == 0, "\nand, \"more\"").otherwise("")))
    quoted = F.concat(F.lit('"'), F.replace("message", F.lit('"'), F.lit('""')), F.lit('"'))
    stamp = F.concat(F.col("second"), F.lit("Z"))
    value = F.concat_ws(",", stamp, render.loose_level(), "source", quoted, "value", "k", "user_id", "status", F.coalesce("address", F.lit("")))
    lines = facts.select(F.concat(value, F.when(F.col("broken"), ",extra").otherwise("")).alias("value"))
    path = _csv_files(lines, scratch_dir(spark, "multiline"))
    records = csv_record_lines(spark, path, range_bytes=10_000)
    entries = decode_csv(records, render.CSV_HEADER, keep_rejected=True)
    return entries.select(iso_utc(F.col("timestamp")).alias("time"), "level", "source", "message", _field("status").alias("status"), "parse_error")


def export_csv_wide(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines of fifty events each, with a field per event, exported as CSV: columns and values by key."""
    facts = _facts(spark, sf).withColumn("line", F.floor(F.col("event_id") / 50))
    # a line becomes far longer than its events: as many tasks write them as rendered the events
    rows = facts.repartition(facts.rdd.getNumPartitions(), "line").groupBy("line")
    pairs = F.collect_list(F.struct(F.concat(F.lit("key-"), F.col("event_id").cast("string")), F.concat(F.lit("v, "), F.col("event_id").cast("string"))))
    lines = rows.agg(F.to_json(F.map_from_entries(pairs)).alias("value")).select(F.lit("f").alias("file"), "line", "value")
    target = scratch_dir(spark, "wide")
    # a line is nearly all commas, so the files are compressed
    write_csv(decode_json(lines), target, compression="gzip")
    # the header's places, joined with the places of the values; the one comma in a value is followed by a space
    written = read_lines(spark, target).select(F.replace("value", F.lit(", "), F.lit("; ")).alias("value"))
    is_header = F.col("value").startswith("line,")
    names = written.where(is_header).select(F.posexplode(F.split("value", ",")).alias("at", "key")).where("at >= 5").distinct()
    # of a line, only its cells that are not empty become rows: each with the commas since the one before; the last run of
    # commas, which may hold none, is matched too, since a pattern that fails there would try it again from every comma
    filled = written.where(~is_header).select(
        F.substring_index("value", ",", 1).cast("long").alias("line"), F.regexp_extract_all("value", F.lit(",+[^,]*"), F.lit(0)).alias("filled")
    )
    # nothing but commas lies before the last comma of a cell
    texts = filled.select("line", F.transform("filled", lambda c: F.struct(F.length(c).alias("n"), F.substring_index(c, ",", -1).alias("text"))).alias("cells"))
    gaps = texts.select("line", F.col("cells.text").alias("text"), F.transform("cells", lambda c: c["n"] - F.length(c["text"])).alias("gaps"))
    places = F.transform("gaps", lambda _, i: F.aggregate(F.slice("gaps", F.lit(1), i + 1), F.lit(0), lambda place, gap: place + gap))
    cells = gaps.select("line", F.inline(F.arrays_zip(places.alias("place"), F.col("text").alias("cell")))).where("place >= 5 AND cell <> ''")
    values = cells.select("place", "line", F.replace(F.translate("cell", '"', ""), F.lit("; "), F.lit(", ")).alias("value"))
    return names.join(values, F.col("at") == F.col("place")).select("key", (F.col("place") - 4).cast("long").alias("place"), "line", "value")


def analyze_files(spark: SparkSession, sf: str) -> DataFrame:
    """All four formats in one folder tree, recognised per file and searched together."""
    facts = _facts(spark, sf)
    root = scratch_dir(spark, "mixed")
    makers = {"json": render.json_lines, "text": render.text_lines, "csv": render.csv_lines, "syslog": render.syslog_lines}
    for name, make in makers.items():
        if name == "csv":
            lines = make(facts.where(~F.col("broken"))).select("value")
            columns = F.from_csv("value", F.lit(", ".join(f"{c} string" for c in render.CSV_HEADER)), {"escape": '"'})
            # Commas inside quotes count too when a format is recognised.
            plain = lines.select(columns.alias("r")).select("r.*").withColumn("message", F.translate("message", ",", ""))
            plain.write.csv(f"{root}/{name}", header=True, escape='"')
        else:
            make(facts).select("value").write.text(f"{root}/{name}")
    found = analyze(open_logs(spark, f"{root}/*", default_year=YEAR), level="FATAL")
    # all rows as they are, with commas inside quotes and broken ones: not recognised as CSV, so their format is given
    records = _csv_files(render.csv_lines(facts), f"{root}-given/quoted")
    found = found.unionByName(analyze(open_logs(spark, records, "csv"), level="FATAL"))
    folder = F.element_at(F.split("file", "/"), -2).alias("folder")
    return found.groupBy(folder).agg(
        F.count(F.lit(1)).alias("n"), F.count("line").alias("numbered"), iso_utc(F.min("timestamp")).alias("first_time")
    )


def detect_hard_files(spark: SparkSession, sf: str) -> DataFrame:
    """Awkward names and blank beginnings, in four formats, recognised together: entries per folder."""
    facts = _facts(spark, sf)
    root = scratch_dir(spark, "hard")
    # names as paths hold them: a space, pattern characters, and what stands for a space in a URL
    render.json_lines(facts).select("value").write.text(f"{root}/my json")
    render.text_lines(facts).select("value").write.text(f"{root}/text[1]")
    render.syslog_lines(facts).select("value").write.text(f"{root}/sys%20{{log}}#")
    _headed(render.text_lines(facts), "\n" * 12).write.text(f"{root}/late")
    entries = open_logs(spark, f"{root}/*", default_year=YEAR).entries()
    folder = F.url_decode(F.element_at(F.split("file", "/"), -2)).alias("folder")
    return entries.groupBy(folder).agg(F.count(F.lit(1)).alias("n"), F.count("level").alias("with_level"))


def export_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the export job reports, for every format, in order, cut and with nothing to write."""
    logs = open_logs(spark, _write_lines(render.json_lines(_facts(spark, sf)), "logs"), "json").decoded()
    cases = {"plain": {}, "ordered": {"ordered": True}, "limit": {"limit": 5}, "none": {"search": "no such words"}}
    rows = []
    for fmt in ("json", "csv", "raw"):
        for case, given in cases.items():
            done = export(logs, scratch_dir(spark, "export"), fmt, **({"level": "ERROR"} | given))
            rows.append((fmt, case, done.exported, done.total, done.warnings))
    return spark.createDataFrame(rows, "format string, case string, exported long, total long, warnings long")


def export_text_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Plain text, which has no fields, exported as CSV in order and read back with the place of each user's entries in the output."""
    facts = _facts(spark, sf)
    path = _file_per_source(render.text_lines(facts), facts, "logs")
    target = scratch_dir(spark, "export")
    export(open_logs(spark, path, "text"), target, "csv", level="FATAL", ordered=True)
    # a row of a part file follows the parts before it
    back = spark.read.csv(target, header=True, escape='"').select(F.col("_metadata.file_name").alias("part"), F.monotonically_increasing_id().alias("seq"), "*")
    service = F.regexp_extract("message", r"by user (\d+)", 1)
    place = F.row_number().over(Window.partitionBy(service).orderBy("part", "seq"))
    return back.select("timestamp", "level", "source", "message", place.cast("long").alias("place"))


def report_all_errors(spark: SparkSession, sf: str) -> DataFrame:
    """All errors of the JSON report, with the place each has in it."""
    target = scratch_dir(spark, "report")
    write_report_json(report(json_entries(spark, sf), None, "", 0, 0), target)
    parts = spark.read.text(target, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda p: p["value"]), "").alias("value"))
    errors = whole.select(F.from_json("value", "top_errors array<struct<value:string,count:long>>").alias("r"))
    return errors.select(F.posexplode("r.top_errors").alias("place", "e")).select(F.col("place").cast("long").alias("place"), F.col("e.value").alias("error"), F.col("e.count").alias("n"))


def epoch_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch seconds whole, with a fraction, in milliseconds and in quotes, by event."""
    seconds = F.unix_seconds(F.concat("second", F.lit("Z")).cast("timestamp")).cast("string")
    style = F.col("event_id") % 4
    time = (
        F.when(style == 0, F.concat(F.lit('"ts":'), seconds))
        .when(style == 1, F.concat(F.lit('"Time": '), seconds, F.lit(".75")))
        .when(style == 2, F.concat(F.lit('"t":'), seconds, F.lit("000")))
        .otherwise(F.concat(F.lit('"ts":"'), seconds, F.lit('"')))
    )
    value = F.concat(F.lit("{"), time, F.lit(',"event":'), F.col("event_id").cast("string"), F.lit("}"))
    lines = _facts(spark, sf).select(F.lit("events").alias("file"), F.col("event_id").alias("line"), value.alias("value"))
    return decode_json(lines).select("line", iso_utc(F.col("timestamp")).alias("time"))


def stats_files(spark: SparkSession, sf: str) -> DataFrame:
    path = _write_lines(render.syslog_lines(_facts(spark, sf)), "logs")
    rows = stats(open_logs(spark, path, default_year=YEAR), search="purchase", top_errors=0)
    return rows.select("facet", "key", "n", "min", "max")


def follow_filtered(spark: SparkSession, sf: str) -> DataFrame:
    path = _write_lines(render.json_lines(_facts(spark, sf)), "arriving")
    entries = follow(spark, path, "json", search="signup", level="info")
    target = scratch_dir(spark, "followed")
    rows = entries.select(iso_utc(F.col("timestamp")).alias("time"), "level", "source", "message")
    start_query(rows, available_now=True).format("parquet").option("path", target).start().awaitTermination()
    return spark.read.parquet(target)


def _grow(rows: DataFrame, root: str, before: bytes = b"", after: bytes = b"\n") -> None:
    """Append ``value`` to the file of each ``source`` in the order of ``line``, as the services would."""

    def append(batches):
        files = {}
        for batch in batches:
            for row in batch.to_pylist():
                name = row["source"]
                if name not in files:
                    system, path = open_file(f"{root}/{name}.log")
                    files[name] = system.open_append_stream(path)
                    files[name].write(before)
                else:
                    files[name].write(b"\n")
                files[name].write(row["value"].encode())
            yield batch.slice(0, 0)
        for file in files.values():
            file.write(after)
            file.close()

    placed = rows.select("source", "line", "value").repartition("source").sortWithinPartitions("source", "line")
    placed.mapInArrow(append, placed.schema).count()


def follow_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Matches among lines appended to known files while a stream runs; what was there before is not delivered.

    The first lot ends in the middle of a line, as far as the stream can tell, and the second goes on from there.
    """
    facts = _facts(spark, sf)
    lines = render.json_lines(facts).join(facts.select(F.col("event_id").alias("line"), "source"), "line")
    root, target = scratch_dir(spark, "growing"), scratch_dir(spark, "followed")
    system, path = open_file(root)
    system.create_dir(path)
    _grow(lines.where("line % 3 = 0"), root)
    entries = follow_growing(spark, root, "json", search="purchase", level="warn")
    rows = entries.select(iso_utc(F.col("timestamp")).alias("time"), "level", "source", "message")
    running = start_query(rows).format("parquet").option("path", target).start()
    try:
        running.processAllAvailable()
        _grow(lines.where("line % 3 = 1"), root, after=b"")
        running.processAllAvailable()
        _grow(lines.where("line % 3 = 2"), root, before=b"\n")
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(rows.schema).parquet(target)


def stream_level_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = _write_lines(render.syslog_lines(_facts(spark, sf)), "arriving")
    counts = running_level_counts(follow(spark, path, "syslog", default_year=YEAR))
    target = scratch_dir(spark, "counts")
    writer = start_query(counts, "complete", available_now=True)
    writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(target)).start().awaitTermination()
    return spark.read.parquet(target)


def stream_report(spark: SparkSession, sf: str) -> DataFrame:
    path = _write_lines(render.json_lines(_facts(spark, sf)), "arriving")
    running = running_report(follow(spark, path, "json"), "source", with_ips=True)
    target = scratch_dir(spark, "running")
    writer = start_query(running, "complete", available_now=True)
    writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(target)).start().awaitTermination()
    return spark.read.parquet(target).select("facet", "key", "n", "min", "max")


def stream_top(spark: SparkSession, sf: str) -> DataFrame:
    """The cut report after the last of several batches, by files that each bring some of every key."""
    path = scratch_dir(spark, "arriving")
    render.json_lines(_facts(spark, sf)).repartition(3, "line").select("value").write.text(path)
    target = scratch_dir(spark, "top")
    entries = follow(spark, path, "json", files_per_trigger=1)
    deliver = lambda rows, _: rows.write.mode("overwrite").parquet(target)
    top_report(entries, deliver, "source", top_ips=5, top_errors=15, available_now=True).start().awaitTermination()
    figures = [F.round(name, 2).alias(name) for name in ("min", "max", "sum", "avg")]
    return spark.read.parquet(target).select("facet", "key", F.col("rank").cast("bigint").alias("rank"), "n", *figures)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_report": stream_report,
    "stream_top": stream_top,
    "report_wide": report_wide,
    "detect_hard_files": detect_hard_files,
    "export_counts": export_counts,
    "export_text_csv": export_text_csv,
    "report_all_errors": report_all_errors,
    "epoch_timestamps": epoch_timestamps,
    "parse_json_entries": parse_json_entries,
    "parse_text_entries": parse_text_entries,
    "parse_csv_entries": parse_csv_entries,
    "parse_syslog_entries": parse_syslog_entries,
    "parse_warnings": parse_warnings,
    "detect_format": detect_format,
    "detect_format_documents": detect_format_documents,
    "line_numbers": line_numbers,
    "level_normalize": level_normalize,
    "timestamp_layouts": timestamp_layouts,
    "search_keyword": search_keyword,
    "search_keyword_fields": search_keyword_fields,
    "filter_field_regex": filter_field_regex,
    "filter_field_column": filter_field_column,
    "filter_level_exact": filter_level_exact,
    "filter_level_min": filter_level_min,
    "filter_raw_regex": filter_raw_regex,
    "filter_time_range": filter_time_range,
    "filter_chain": filter_chain,
    "matched_total": matched_total,
    "level_counts": level_counts,
    "group_by_source": group_by_source,
    "group_by_field": group_by_field,
    "group_counts_orders": group_counts_orders,
    "top_ips": top_ips,
    "top_errors": top_errors,
    "numeric_stats": numeric_stats,
    "numeric_stats_lineitem": numeric_stats_lineitem,
    "full_report": full_report,
    "head_limit": head_limit,
    "tail_n": tail_n,
    "tail_large": tail_large,
    "head_files": head_files,
    "tail_files": tail_files,
    "file_order": file_order,
    "follow_appended": follow_appended,
    "export_json_roundtrip": export_json_roundtrip,
    "export_csv_roundtrip": export_csv_roundtrip,
    "export_raw_roundtrip": export_raw_roundtrip,
    "export_parquet_by_date": export_parquet_by_date,
    "listing": listing,
    "report_object": report_object,
    "report_csv_sections": report_csv_sections,
    "analyze_files": analyze_files,
    "csv_multiline_files": csv_multiline_files,
    "export_csv_wide": export_csv_wide,
    "stats_files": stats_files,
    "follow_filtered": follow_filtered,
    "stream_level_counts": stream_level_counts,
}
