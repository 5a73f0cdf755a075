"""Queries on tables of their own rows, held to work that grows with the input alone."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tallylog.catalogue import queries, render
from tallylog.sinks import entries as sink
from tallylog.sinks.entries import csv_header, csv_lines, field_keys, write_csv
from tallylog.sources import logs
from tests.helpers import make_entries


def events(spark, path, n):
    """An ``events`` table of one row group."""
    rows = spark.range(n).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts"),
        (F.col("id") % 40).alias("user_id"),
        F.get(F.array(*map(F.lit, ("view", "click", "signup", "purchase", "error"))), F.col("id") % 5).alias("event_type"),
        (F.col("id") % 300).cast("double").alias("value"),
        F.lit('{"k": 1}').alias("props"),
    )
    rows.coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_csv_cells_lie_under_their_keys(spark):
    entries = make_entries(
        spark,
        {"message": "m", "fields": {"b": "x, y", "z": "", "a": ' "q"'}},
        {"fields": {"e": "last", "é": "ü", "unasked": "no"}},
        {"fields": None},
        {},
    )
    # keys in any order, also twice
    lines = csv_lines(entries, ["z", "b", "é", "a", "b", "e"]).collect()
    assert [row["value"] for row in lines] == ['1,,,,m,,"x, y",," ""q""","x, y",', "2,,,,,,,ü,,,last", "3,,,,,,,,,,", "4,,,,,,,,,,"]
    assert [row["value"] for row in csv_lines(entries, []).collect()] == ["1,,,,m", "2,,,,", "3,,,,", "4,,,,"]


def test_csv_work_does_not_grow_with_fields_times_keys(spark):
    rows = spark.range(800).select(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.concat(F.lit("key-"), F.col("id") * 50 + i)).alias("keys"), F.col("id").alias("line"))
    entries = rows.select(*(F.lit(None).cast("string").alias(c) for c in ("level", "source", "message")), F.lit(None).cast("timestamp").alias("timestamp"), "line", F.map_from_arrays("keys", "keys").alias("fields"))
    keys = field_keys(entries)
    began = time.monotonic()
    lengths = csv_lines(entries, keys).agg(F.sum(F.length("value")), F.sum(F.length(F.replace("value", F.lit(","))))).first()
    assert time.monotonic() - began < 25
    assert lengths[0] - lengths[1] == 800 * (len(keys) + 4) and lengths[1] == sum(map(len, keys)) + sum(len(str(i)) for i in range(800))


def test_no_plan_of_a_wide_export_holds_its_keys(spark, tmp_path, monkeypatch):
    plans = []
    write = DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path, **more: (plans.append(self._df._jdf.queryExecution().logical().toString()), write(self, path, **more))[1])
    monkeypatch.setattr(queries, "scratch_dir", lambda spark, name: f"{tmp_path}/{name}")
    n = 12_000
    found = queries.export_csv_wide(spark, events(spark, tmp_path, n)).collect()
    # a key takes nine bytes at least
    assert len(plans) == 1 and len(plans[0]) < 5 * n
    # nor does the disk hold a byte per line and key
    assert sum(part.stat().st_size for part in Path(f"{tmp_path}/wide").glob("part-*")) < n * (n // 50) // 4
    assert sorted((r["line"], r["key"], r["value"]) for r in found) == sorted((i // 50, f"key-{i}", f"v, {i}") for i in range(n))
    assert [r["key"] for r in sorted(found, key=lambda r: r["place"])] == sorted(f"key-{i}" for i in range(n))


@pytest.mark.parametrize("keys", [None, ["z", "b", "é", "a", "b", "line", "Z", "unasked"]])
def test_many_keys_are_written_as_few(spark, tmp_path, monkeypatch, keys):
    taken = ("Line", "line", "fields.line", "FIELDS.Line", "LINE", "fields.", "fields.fields.", "", "Message")
    entries = make_entries(
        spark,
        {"message": 'm, "x"', "fields": {"b": "x, y", "z": "", "a": ' "q"'} | {key: str(i) for i, key in enumerate(taken)}},
        {"fields": {"e": "last", "é": "ü", "B": "no", "E": None, "x,y": "comma", 'a "b" ': "quotes"}},
        {"fields": None},
        {},
        *({"message": f"m{i}", "fields": {f"k{i % 7}": str(i), f"u{i}": "v,"}} for i in range(100)),
    )
    # in an order that is not that of the lines, which the part files keep
    entries = entries.repartitionByRange(4, F.col("line").desc()).sortWithinPartitions(F.col("line").desc())
    names = csv_header(field_keys(entries) if keys is None else keys)
    header = spark.createDataFrame([(names,)], "names array<string>").select(F.array_join(F.transform("names", sink._csv_value), ",")).first()[0]
    texts = []
    for most in (1_000, 3):
        monkeypatch.setattr(sink, "KEYS_IN_PLAN", most)
        monkeypatch.setattr(sink, "NAMES_PER_TASK", 4)
        write_csv(entries, f"{tmp_path}/{most}", keys=keys)
        parts = [part.read_text().split("\n") for part in sorted(Path(f"{tmp_path}/{most}").glob("part-*"))]
        assert len(parts) > 1 and all(part[0] == header for part in parts)
        texts.append([line for part in parts for line in part[1:] if line])
    assert texts[0] == texts[1] and [int(line.split(",")[0]) for line in texts[0]] == [*range(104, 0, -1)]


def test_wide_export_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch_dir", lambda spark, name: f"{tmp_path}/{name}")
    found = queries.export_csv_wide(spark, events(spark, tmp_path, 2_000)).collect()
    assert sorted((r["line"], r["value"]) for r in found) == sorted((i // 50, f"v, {i}") for i in range(2_000))
    assert [r["key"] for r in sorted(found, key=lambda r: r["place"])] == sorted(f"key-{i}" for i in range(2_000))
    assert len([*Path(f"{tmp_path}/wide").glob("part-*")]) > 1


def test_events_are_rendered_in_tasks_of_bounded_size(spark, tmp_path):
    rows = queries._facts(spark, events(spark, tmp_path, 600_000))
    most = rows.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
    assert most <= render.ROWS_PER_TASK * 1.1


def test_no_task_holds_all_late_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch_dir", lambda spark, name: f"{tmp_path}/{name}")
    found = queries.detect_hard_files(spark, events(spark, tmp_path, 4_000)).collect()
    assert {r["folder"]: r["n"] for r in found} == dict.fromkeys(("my json", "text[1]", "sys%20{log}#", "late"), 4_000)
    parts = [part.read_text() for part in Path(f"{tmp_path}/hard/late").glob("part-*")]
    assert len(parts) > 1 and all(text.startswith("\n" * 12) and text[12] != "\n" for text in parts)


def test_exports_of_one_source_decode_it_once(spark, tmp_path, monkeypatch):
    decoded = []
    decode = logs.decode
    monkeypatch.setattr(logs, "decode", lambda *given, **more: (decoded.append(1), decode(*given, **more))[1])
    rows = queries.export_counts(spark, events(spark, tmp_path, 1_000)).collect()
    assert len(decoded) == 1 and len(rows) == 12
    # every fifth event is an error, INFO for none; severe ones (value from 200 on) are fatal; broken signups have a value below 5
    severe = sum(i % 5 == 4 and i % 300 >= 200 for i in range(1_000))
    broken = sum(i % 5 == 2 and i % 300 < 5 for i in range(1_000))
    for row in rows:
        assert row.exported == {"limit": 5, "none": 0}.get(row.case, 200 - severe)
        assert (row.total, row.warnings) == (1_000, broken)
