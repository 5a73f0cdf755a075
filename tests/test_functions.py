from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallylog.functions import epoch_timestamp, iso_utc, normalize_level, parse_timestamp, syslog_timestamp
from tallylog.functions.levels import display_rank, filter_rank, normalize_level_name
from tallylog.model import LEVEL_SPELLINGS
from tallylog.plans.scratch import scratch_dir

LEVELS = {
    **{form(spelling): level for level, spellings in LEVEL_SPELLINGS.items() for spelling in spellings for form in (str.upper, str.lower, str.title)},
    **{level: level for level in LEVEL_SPELLINGS},
    "gOSSip": "GOSSIP", "\u00a0Err\u2003": "ERROR", "warn!": "WARN!", "": "",
}

TIMES = {
    "2024-01-15T08:23:01Z": "2024-01-15T08:23:01Z",
    "2024-01-15T08:23:01.123Z": "2024-01-15T08:23:01Z",
    "2024-01-15T08:23:01.123456789+05:30": "2024-01-15T02:53:01Z",
    "2024-01-15T08:23:01": "2024-01-15T08:23:01Z",
    "2024-01-15 08:23:01": "2024-01-15T08:23:01Z",
    "  2024-01-15   8:23:01 ": "2024-01-15T08:23:01Z",
    "2024-01-15 08:23:01.000": "2024-01-15T08:23:01Z",
    "2024-01-15 08:23:01,999": "2024-01-15T08:23:01Z",
    "2024/01/02 15:04:05": "2024-01-02T15:04:05Z",
    "2024/01/02 15:04:05.123": "2024-01-02T15:04:05Z",
    "15/Jan/2024:08:23:01 -0130": "2024-01-15T09:53:01Z",
    "Jan  2 15:04:05": "2023-01-02T15:04:05Z",
    "feb 12 15:04:05.5": "2023-02-12T15:04:05Z",
    "Feb 29 15:04:05": "2023-03-01T15:04:05Z",
    "Mon Jan  2 15:04:05 2006": "2006-01-02T15:04:05Z",
    "Mon Jan  2 15:04:05 UTC 2006": "2006-01-02T15:04:05Z",
    "Mon Jan 02 15:04:05 -0700 2006": "2006-01-02T22:04:05Z",
    "2024-03-10 02:30:00": "2024-03-10T02:30:00Z",
    "2024-01-15 08:23:01Z": None,
    "2024/01/15T08:23:01": None,
    "2024-02-30T08:23:01Z": None,
    "15/Jan/2024:08:23:01": None,
    "Jax 2 15:04:05": None,
    "Feb 30 15:04:05": None,
    "2024-01-15": None,
    "2024": None,
    "not a timestamp": None,
    "": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_parse_timestamp(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(text,) for text in TIMES], "text string")
        rows = frame.select("text", iso_utc(parse_timestamp(F.col("text"), 2023)).alias("time")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {row["text"]: row["time"] for row in rows} == TIMES


def test_epoch_and_syslog_times(spark):
    frame = spark.createDataFrame([("1705306981.5", "Jun \t 5 14:30:00"), ("1e400", "Feb 29 00:00:00"), ("x", "no")], "a string, b string")
    rows = frame.select(F.unix_micros(epoch_timestamp(F.col("a"))), iso_utc(syslog_timestamp(F.col("b"), 2024))).collect()
    assert [tuple(row) for row in rows] == [
        (1705306981500000, "2024-06-05T14:30:00Z"),
        (None, "2024-02-29T00:00:00Z"),
        (None, None),
    ]


def test_levels(spark):
    frame = spark.createDataFrame([(text,) for text in LEVELS], "text string")
    rows = frame.select("text", normalize_level(F.col("text")).alias("level")).collect()
    assert {row["text"]: row["level"] for row in rows} == LEVELS
    assert {text: normalize_level_name(text) for text in LEVELS} == LEVELS


def test_ranks(spark):
    frame = spark.createDataFrame([("FATAL",), ("PANIC",), ("TRACE",), ("OTHER",)], "level string")
    rows = frame.select(filter_rank(F.col("level")), display_rank(F.col("level"))).collect()
    assert [tuple(row) for row in rows] == [(5, 6), (6, 5), (0, 0), (None, -1)]


def test_rendering_of_far_years(spark):
    micros = [1705306981500 * 1_000_000, -1, -62135596800 * 1_000_000, 253402300800 * 1_000_000]
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(micros)], "i int, m long")
    rows = frame.select("i", iso_utc(F.timestamp_micros("m")).alias("text")).orderBy("i").collect()
    assert [r.text for r in rows] == ["+56009-01-10T07:45:00Z", "1969-12-31T23:59:59Z", "0001-01-01T00:00:00Z", "+10000-01-01T00:00:00Z"]


def test_scratch_needs_a_shared_folder(spark):
    class Master:
        def __init__(self, master, folder=None):
            self.sparkContext = type("Context", (), {"master": master})()
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder)})()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_dir(Master("spark://head:7077"), "x")
    assert scratch_dir(Master("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert "/x-" in scratch_dir(Master("local[2]"), "x")
