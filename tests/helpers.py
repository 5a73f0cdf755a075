from __future__ import annotations

from pyspark.sql import functions as F

from tallylog.functions import iso_utc
from tallylog.model import ENTRY_SCHEMA


def lines_of(spark, *values):
    rows = [("f", i, value) for i, value in enumerate(values, start=1)]
    return spark.createDataFrame(rows, "file string, line long, value string")


def rows_of(entries):
    """Collected entries by line, the time as text."""
    return entries.withColumn("time", iso_utc(F.col("timestamp"))).orderBy("line", "pos").collect()


def make_entries(spark, *entries):
    """Entries from dicts; ``time`` is RFC 3339 text in UTC."""
    names = ("level", "source", "message", "fields", "raw")
    rows = [
        ("f", i, *[e.get(n, {} if n == "fields" else None) for n in names], e.get("time"))
        for i, e in enumerate(entries, start=1)
    ]
    schema = "file string, line long, level string, source string, message string, fields map<string,string>, raw string, time string"
    frame = spark.createDataFrame(rows, schema)
    missing = {
        "pos": F.lit(None).cast(ENTRY_SCHEMA["pos"].dataType),
        "parse_error": F.lit(None).cast("string"),
        "timestamp": F.col("time").cast("timestamp"),
    }
    return frame.withColumns(missing).select(*ENTRY_SCHEMA.fieldNames())


def write_file(path, text):
    path.write_bytes(text.encode())
    return f"file:{path}"
