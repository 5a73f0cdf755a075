from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from tests.helpers import make_entries

from tallylog.operators import (
    build_filter, field_filter, group_counts, head, keyword_filter, level_counts, level_filter, numeric_stats,
    raw_filter, report, summary, tail, time_filter, top_addresses, top_errors, top_n,
)
from tallylog.sinks import listing_lines, report_fragments


@pytest.mark.parametrize(
    "entry",
    [
        {"level": "INFO", "message": "pump 3 sends eRrOr code 9", "raw": "pump 3"},
        {"level": "ERROR", "message": "valve shut"},
        {"message": "x", "source": "error-gateway"},
        {"message": "x", "fields": {"service": "ERROR-cache"}},
        {"raw": "an Error"},
    ],
)
def test_keyword(spark, entry):
    entries = make_entries(spark, entry, {"level": "INFO", "message": "Request", "fields": {"a": "er", "b": "ror"}})
    assert [r.line for r in entries.where(keyword_filter("eRRor")).collect()] == [1]


def _matching(spark, condition, *entries):
    return [r.line for r in make_entries(spark, *entries).where(condition).orderBy("line").collect()]


def test_field_filter(spark):
    entries = [
        {"level": "ERROR", "message": "lease of berth ran out", "fields": {"Status": "503"}},
        {"source": "web", "fields": {"status": "200", "empty": ""}},
    ]
    assert _matching(spark, field_filter("level:ERROR"), *entries) == [1]
    assert _matching(spark, field_filter(" severity : ^$ "), *entries) == [2]
    assert _matching(spark, field_filter("message:ran"), *entries) == [1]
    assert _matching(spark, field_filter("hostname:we"), *entries) == [2]
    assert _matching(spark, field_filter(r"status:5\d{2}"), *entries) == [1]
    assert _matching(spark, field_filter("STATUS:^2"), *entries) == [2]
    assert _matching(spark, field_filter("empty:^$"), *entries) == [2]
    assert _matching(spark, ~field_filter("empty:^$"), *entries) == [1]


def test_level_filter(spark):
    names = ("INFO", "WARN", "ERROR", "FATAL", "PANIC", None, "NOTICE")
    entries = [{"level": name} for name in names]
    assert _matching(spark, level_filter("err"), *entries) == [3]
    assert _matching(spark, level_filter("warning", exact=False), *entries) == [2, 3, 4, 5]
    assert _matching(spark, level_filter("odd", exact=False), *entries) == [1, 2, 3, 4, 5]
    assert _matching(spark, level_filter("notice"), *entries) == [7]


def test_raw_and_time_filter(spark):
    entries = [
        {"raw": "peer 203.0.113.77 hung up", "time": "2024-01-15T08:30:00Z"},
        {"raw": "turbine 4 spun down", "time": "2024-01-15T09:00:00Z"},
        {"raw": "no time 100.1.1.1"},
    ]
    assert _matching(spark, raw_filter(r"^peer [\d.]+ hung|no time \S+$"), *entries) == [1, 3]
    assert _matching(spark, time_filter("2024-01-15T08:30:00Z", "2024-01-15T10:00:00+01:00"), *entries) == [1, 2]
    assert _matching(spark, time_filter("2024-01-15T08:30:00.5Z"), *entries) == [2]
    assert _matching(spark, time_filter(time_to="2024-01-15T08:59:59Z"), *entries) == [1]


def test_build_filter(spark):
    entries = [
        {"level": "ERROR", "message": "timeout", "raw": "timeout 30ms", "fields": {"status": "500"}, "time": "2024-01-15T08:30:00Z"},
        {"level": "INFO", "message": "timeout", "raw": "timeout 30ms", "fields": {"status": "500"}, "time": "2024-01-15T08:30:00Z"},
    ]
    assert build_filter().is_empty
    assert _matching(spark, build_filter().predicate, *entries) == [1, 2]
    every = build_filter("timeout", ["status:500"], "ERROR", r"\d+ms", "2024-01-15T08:00:00Z", "2024-01-15T09:00:00Z")
    assert every.on_raw is not None and _matching(spark, every.predicate, *entries) == [1]
    own = build_filter(where=F.col("level") == "INFO")
    assert _matching(spark, own.predicate, *entries) == [2]
    for bad in (
        {"filters": ["no-colon"]},
        {"filters": ["field:[invalid"]},
        {"regex": "[invalid"},
        {"time_from": "not-a-time"},
        {"time_to": "2024-01-15"},
        {"time_from": "2024-13-15T08:00:00Z"},
    ):
        with pytest.raises(ValueError):
            build_filter(**bad)


def test_counts(spark):
    entries = make_entries(
        spark,
        {"level": "INFO", "time": "2024-01-15T08:00:00Z", "fields": {"ip": "1", "Status": "a"}},
        {"level": "INFO", "time": "2024-01-15T10:00:00Z", "fields": {"ip": "", "client_ip": "2"}},
        {"level": "ERROR", "message": "x" * 150, "time": "2024-01-15T09:00:00Z", "fields": {"REMOTE_ADDR": "2"}},
        {"level": "FATAL", "raw": "only raw"},
        {"level": "PANIC", "message": "b", "fields": {"status": ""}},
    )
    assert [tuple(r) for r in level_counts(entries).collect()] == [("FATAL", 1), ("PANIC", 1), ("ERROR", 1), ("INFO", 2)]
    assert tuple(summary(entries, level_filter("INFO")).head()) == (5, 2, "2024-01-15T08:00:00Z", "2024-01-15T10:00:00Z")
    assert tuple(summary(entries.where("false")).head()) == (0, 0, None, None)
    assert [tuple(r) for r in group_counts(entries, "STATUS").collect()] == [("a", 1)]
    assert {tuple(r) for r in group_counts(entries, "severity").collect()} == {("INFO", 2), ("ERROR", 1), ("FATAL", 1), ("PANIC", 1)}
    assert [tuple(r) for r in top_addresses(entries, 5).collect()] == [("2", 2), ("1", 1)]
    assert [tuple(r) for r in top_errors(entries, 0).collect()] == [("b", 1), ("only raw", 1), ("x" * 100 + "...", 1)]


def test_top_n(spark):
    counts = spark.createDataFrame([("a", 5), ("d", 10), ("c", 3), ("b", 10)], "value string, count long")
    assert [tuple(r) for r in top_n(counts, 3).collect()] == [("b", 10), ("d", 10), ("a", 5)]
    assert len(top_n(counts, 10).collect()) == len(top_n(counts, 0).collect()) == 4


def test_numeric_stats(spark):
    texts = ["10", "+20.", ".5e1", "5d", " 5 ", "0x1p3", "NaN", "inf", "1e999", "", "-3", "1_0"]
    entries = make_entries(spark, *[{"fields": {"v": text, "w": "x"}} for text in texts])
    assert [tuple(r) for r in numeric_stats(entries).collect()] == [("v", 4, -3.0, 20.0, 32.0, 8.0)]


def _report(spark):
    entries = make_entries(
        spark,
        {"level": "ERROR", "message": "a", "fields": {"ip": "1", "n": "2"}, "time": "2024-01-15T08:00:00Z"},
        {"level": "ERROR", "message": "b", "fields": {"ip": "2", "n": "4"}},
        {"level": "ERROR", "message": "b", "fields": {"ip": "2"}, "source": "s"},
        {"level": "INFO", "message": "c", "fields": {"ip": "2", "n": "100"}, "time": "2025-01-15T08:00:00Z"},
    )
    return entries


def test_report(spark):
    rows = report(_report(spark), level_filter("ERROR"), "Source", 1, 2).collect()
    got = {(r.facet, r.key): (r["rank"], r.n, r["min"], r["max"], r["sum"], r.avg) for r in rows}
    none = (None,) * 4
    assert got == {
        ("summary", "total_entries"): (None, 4, *none),
        ("summary", "matched_entries"): (None, 3, *none),
        ("first_timestamp", "2024-01-15T08:00:00Z"): (None, None, *none),
        ("last_timestamp", "2024-01-15T08:00:00Z"): (None, None, *none),
        ("level", "ERROR"): (None, 3, *none),
        ("group:source", "s"): (None, 1, *none),
        ("ip", "2"): (1, 2, *none),
        ("error", "b"): (1, 2, *none),
        ("error", "a"): (2, 1, *none),
        ("number", "n"): (None, 2, 2.0, 4.0, 6.0, 3.0),
        ("number", "ip"): (None, 3, 1.0, 2.0, 5.0, 5 / 3),
    }


def test_report_large_and_unlimited_ranks(spark):
    entries = _report(spark)
    small = report(entries, None, "", 3, 3).where("facet = 'error'").select("key", "rank", "n")
    large = report(entries, None, "", 5000, 5000).where("facet = 'error'").select("key", "rank", "n")
    assert sorted(small.collect()) == sorted(large.collect())
    everything = report(entries, None, "", 0, 0)
    assert {r.key for r in everything.where("facet = 'error'").collect()} == {"a", "b"}
    assert everything.where("facet = 'ip'").isEmpty()


def test_report_reads_its_figures_once(spark):
    """Ranked and unranked facets share one exchange of partial figures, and no window sees an unranked facet."""
    entries = make_entries(spark, *({"level": "ERROR", "message": f"m{i % 9}", "source": f"s{i}", "fields": {"ip": f"10.0.0.{i}"}} for i in range(40)))
    rows = report(entries, group_by="source", top_ips=3, top_errors=2)
    assert sorted((r.facet, r.rank) for r in rows.collect() if r["rank"]) == [("error", 1), ("error", 2), ("ip", 1), ("ip", 2), ("ip", 3)]
    assert rows.where("facet = 'group:source' AND rank IS NULL").count() == 40
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1
    windows = [line for line in plan.splitlines() if " Window [" in line or line.strip().startswith("Window [")]
    assert all("facet" in line for line in windows)


def test_report_of_nothing(spark):
    rows = report(_report(spark).where("false"), None, "level", 5, 5).collect()
    assert rows == []


def test_report_json(spark):
    text = "".join(r.json for r in report_fragments(report(_report(spark), level_filter("ERROR"), "level", 1, 2)).orderBy("section", "at", "name").collect())
    assert json.loads(text) == {
        "summary": {
            "matched_entries": 3,
            "total_entries": 4,
            "first_timestamp": "2024-01-15T08:00:00Z",
            "last_timestamp": "2024-01-15T08:00:00Z",
        },
        "level_counts": {"ERROR": 3},
        "group_counts": {"level": {"ERROR": 3}},
        "numeric_stats": {
            "n": {"count": 2, "min": 2.0, "max": 4.0, "sum": 6.0, "avg": 3.0},
            "ip": {"count": 3, "min": 1.0, "max": 2.0, "sum": 5.0, "avg": 5 / 3},
        },
        "top_ips": [{"value": "2", "count": 2}],
        "top_errors": [{"value": "b", "count": 2}, {"value": "a", "count": 1}],
    }
    everything = report_fragments(report(_report(spark), top_errors=0)).orderBy("section", "at", "name").collect()
    errors = json.loads("".join(r.json for r in everything))["top_errors"]
    assert [e["count"] for e in errors] == sorted((e["count"] for e in errors), reverse=True)


def test_head_and_tail(spark):
    entries = make_entries(spark, *[{"message": str(i)} for i in range(3000)])
    two = entries.unionByName(entries.withColumn("file", F.lit("g")).where("line <= 5"))
    assert [(r.file, r.line) for r in head(two, 2).collect()] == [("f", 1), ("f", 2)]
    assert head(two, 3, ordered=False).count() == 3 and head(two, 0).count() == 3005
    assert [(r.file, r.line) for r in tail(two, 2).collect()] == [("f", 2999), ("f", 3000), ("g", 4), ("g", 5)]
    long = tail(two, 2500).collect()
    assert [r.line for r in long if r.file == "f"] == list(range(501, 3001)) and len(long) == 2505


def test_listing(spark):
    entries = make_entries(
        spark, {"time": "2024-01-15T08:00:00Z", "level": "WARN", "source": "s", "message": "m"}, {"message": "only"}, {"level": "CUSTOMLEVEL"}
    )
    lines = [r.listing for r in listing_lines(entries).orderBy("line").collect()]
    assert lines == ["2024-01-15 08:00:00 WARN  [s] m", "only", "CUSTOMLEVEL "]
