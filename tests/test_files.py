"""Files in, files out: scans, recognition, numbering, jobs, sinks and streams."""

from __future__ import annotations

import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F
from tests.helpers import write_file

from tallylog import aggregate, analyze, export, follow, open_logs, read_logs, stats, tail_logs
from tallylog.sinks import field_keys, write_csv, write_json, write_parquet, write_report_csv, write_report_json
from tallylog.sources import file_heads, parse_format
from tallylog.sources.detect import first_lines, listed_files
from tallylog.streaming import running_level_counts, start_query

JSON = """{"timestamp":"2024-01-15T08:23:01Z","level":"info","msg":"started","service":"api","ip":"10.0.0.1"}

{"timestamp":"2024-01-15T08:24:01Z","level":"error","msg":"Redis, failed","status":500,"ip":"10.0.0.2"}\r
broken
{"timestamp":"2024-01-15T08:25:01Z","level":"fatal","msg":"out of memory","status":500,"ip":"10.0.0.2"}
"""
TEXT = "".join(f"2024-01-15 08:{i // 60:02d}:{i % 60:02d} {'ERROR' if i % 7 == 0 else 'INFO'} message {i}\n" for i in range(600))
CSV = "ts,severity,msg,host,status\n" + "".join(f"2024-01-15T08:23:01Z,warn,m{i},h{i % 3},{200 + i % 5}\n" for i in range(300)) + "bad,row\n"
SYSLOG = "".join(f"<{11 + i % 4}>Jan 15 08:{i // 60:02d}:{i % 60:02d} host{i % 3} app[{i}]: said {i}\n" for i in range(300))


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, "2000")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.fixture
def folder(tmp_path):
    for name, text in (("a.json", JSON), ("b.log", TEXT), ("c.csv", CSV), ("d.syslog", SYSLOG)):
        write_file(tmp_path / name, text)
    return tmp_path


def test_format_names():
    for name, fmt in {"auto": "auto", "": "auto", "JSON": "json", "plain": "text", "txt": "text", "  json  ": "json", "csv": "csv"}.items():
        assert parse_format(name) == fmt
    for name in ("xml", "unknown"):
        with pytest.raises(ValueError):
            parse_format(name)


@pytest.mark.parametrize(
    ("text", "fmt"),
    [
        ('{"q": 7}\n\n{"q": [8, 9]}\nstray words\n', "json"),
        ("{ half\n{ braces\nbut, two, commas\nthen, two, more\n", "text"),
        ("when;x,lvl,what\n\n9,TRACE,pump on\n10,TRACE,pump off\n", "csv"),
        ("<7>a,b,c\n<7>d,e,f\n", "syslog"),
        ("Oct 31 23:59:59 crane-4 lift[77]: up\nnonsense\nNov  1 00:00:00 crane-4 lift[77]: down\n", "syslog"),
        ("Marble arrived\nJunk left\nwhatever\n", "syslog"),
        ("2031/12/09 05:06:07 DEBUG valve shut\n", "text"),
        ("\n" * 12 + '{"late": true}\n', "text"),
        ("\n \n  {\"a\":1}\nplain\n", "text"),
        ("a,b,c\n1,2\n", "text"),
        ("one,two,three", "csv"),
    ],
)
def test_detection(spark, tmp_path, text, fmt):
    path = write_file(tmp_path / "x", text)
    assert [branch.fmt for branch in open_logs(spark, path).branches] == [fmt]


def test_empty_file(spark, tmp_path):
    path = write_file(tmp_path / "empty", "")
    logs = open_logs(spark, path)
    assert logs.entries().count() == 0 and logs.number(logs.entries()).count() == 0 and logs.is_empty()
    assert read_logs(spark, path, "json").count() == 0
    with pytest.raises(ValueError, match="no line"):
        export(logs, f"file:{tmp_path}/out")


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        open_logs(spark, f"file:{tmp_path}/none", "json").entries()


def test_mixed_folder_with_small_splits(spark, folder, small_splits):
    logs = open_logs(spark, f"file:{folder}", default_year=2024)
    assert sorted(branch.fmt for branch in logs.branches) == ["csv", "json", "syslog", "text"]
    assert logs.entries().count() == 4 + 600 + 300 + 300
    entries = logs.number(logs.entries())
    assert entries.select("pos.block").distinct().count() > 5
    name = F.substring_index("file", "/", -1).alias("name")
    got = {}
    for row in entries.select(name, "line", "message").collect():
        got.setdefault(row.name, {})[row.line] = row.message
    assert got["a.json"] == {1: "started", 3: "Redis, failed", 4: "broken", 5: "out of memory"}
    assert got["b.log"] == {i + 1: f"message {i}" for i in range(600)}
    assert got["c.csv"] == {i + 2: f"m{i}" for i in range(300)}
    assert got["d.syslog"] == {i + 1: f"said {i}" for i in range(300)}
    warnings = {r.name: r.parse_error for r in logs.warnings().select(name, "parse_error").collect()}
    assert warnings == {"a.json": "line is not a JSON object", "c.csv": "wrong number of fields"}


def test_numbering_with_a_shuffled_join(spark, folder, small_splits):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = read_logs(spark, f"file:{folder}/b.log", "text")
        limited = analyze(open_logs(spark, f"file:{folder}/b.log", "text"), limit=400).collect()
        ending = tail_logs(open_logs(spark, f"file:{folder}/b.log", "text"), n=300, line_numbers=True).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r.line for r in limited] == list(range(1, 401)) and [r.line for r in ending] == list(range(301, 601))
    assert {r.line: r.message for r in numbered.collect()} == {i + 1: f"message {i}" for i in range(600)}


def test_two_csv_headers_and_gzip(spark, tmp_path):
    write_file(tmp_path / "a.csv", "time,level,msg\n2024-01-15T08:23:01Z,err,one\n")
    write_file(tmp_path / "b.csv", "level,description,app\ninfo,two,web\n")
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"level,text,host\nwarn,three,db\n"))
    rows = read_logs(spark, f"file:{tmp_path}").orderBy("message").collect()
    assert [(r.line, r.level, r.message, r.source) for r in rows] == [
        (2, "ERROR", "one", None),
        (2, "WARN", "three", "db"),
        (2, "INFO", "two", "web"),
    ]


def test_multiline_csv(spark, tmp_path):
    path = write_file(tmp_path / "m.csv", 'level,msg,n\ninfo,"two\nlines",1\nwarn,one,2\n')
    logs = open_logs(spark, path, "csv", multiline_csv=True)
    assert sorted(r.message for r in logs.entries().collect()) == ["one", "two\nlines"]


def test_analyze(spark, folder, small_splits):
    logs = open_logs(spark, f"file:{folder}/b.log")
    rows = analyze(logs, level="ERROR", limit=3).collect()
    assert [(r.line, r.message) for r in rows] == [(1, "message 0"), (8, "message 7"), (15, "message 14")]
    assert analyze(logs, regex="message 59[0-9]$", line_numbers=False).count() == 10
    assert analyze(logs, search="MESSAGE 59", filters=["message:9$"]).count() == 2


def test_raw_filter_runs_before_decoding(spark, folder):
    plan = analyze(open_logs(spark, f"file:{folder}/a.json", "json"), regex="Redis", line_numbers=False)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # A plan prints its last step first.
    assert text.count("from_json") == 1 and text.index("from_json") < text.index("Redis")
    assert [r.message for r in plan.collect()] == ["Redis, failed"]


def test_aggregate_and_stats(spark, folder):
    logs = open_logs(spark, f"file:{folder}/a.json")
    rows = {(r.facet, r.key): r.n for r in aggregate(logs, group_by="status", top_ips=1, search="of").collect()}
    assert rows[("summary", "total_entries")] == 4 and rows[("summary", "matched_entries")] == 1
    assert rows[("group:status", "500")] == 1 and rows[("ip", "10.0.0.2")] == 1 and ("ip", "10.0.0.1") not in rows
    errors = [r.key for r in stats(logs).where("facet = 'error'").orderBy("rank").collect()]
    assert errors == ["Redis, failed", "out of memory"]


def test_tail(spark, folder, small_splits):
    logs = open_logs(spark, f"file:{folder}/b.log")
    assert [r.message for r in tail_logs(logs, 3).collect()] == ["message 597", "message 598", "message 599"]
    assert [r.message for r in tail_logs(logs, 10, level="ERROR").collect()] == ["message 595"]
    last = tail_logs(logs, 2, level="ERROR", filter_first=True, line_numbers=True).orderBy("line").collect()
    assert [(r.line, r.message) for r in last] == [(589, "message 588"), (596, "message 595")]
    assert tail_logs(logs, 1500).count() == 600
    every = open_logs(spark, f"file:{folder}")
    assert tail_logs(every, 2).count() == 8
    plan = tail_logs(logs, 3)._jdf.queryExecution().optimizedPlan().toString()
    # A plan prints its last step first: the window is below the decoder.
    assert plan.index("regexp_replace") < plan.index("Window")


def _json_rows(path):
    return [json.loads(line) for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_export(spark, folder, tmp_path):
    logs = open_logs(spark, f"file:{folder}/a.json")
    out = tmp_path / "out.json"
    result = export(logs, f"file:{out}", "json", search="o")
    assert (result.exported, result.total, result.warnings) == (4, 4, 1)
    rows = _json_rows(out)
    assert {"line": 4, "message": "broken"} in rows
    one = export(logs, f"file:{tmp_path}/one", "json", level="error", limit=5)
    assert (one.exported, one.total, one.warnings) == (1, 4, 1)
    assert _json_rows(tmp_path / "one") == [
        {
            "line": 3,
            "timestamp": "2024-01-15T08:24:01Z",
            "level": "ERROR",
            "message": "Redis, failed",
            "fields": {"status": "500", "ip": "10.0.0.2"},
        }
    ]
    with pytest.raises(ValueError):
        export(logs, f"file:{tmp_path}/x", "xml")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        export(logs, f"file:{out}", "json")


def test_export_counts_rejected_rows(spark, folder, tmp_path):
    result = export(open_logs(spark, f"file:{folder}/c.csv"), f"file:{tmp_path}/o", "csv", filters=["status:^20[01]"])
    assert (result.exported, result.total, result.warnings) == (120, 300, 1)
    rows = spark.read.csv(f"file:{tmp_path}/o", header=True)
    assert rows.columns == ["line", "timestamp", "level", "source", "message", "host", "msg", "severity", "status", "ts"]
    assert rows.count() == 120


def test_decoded_source_equals_its_files(spark, folder, tmp_path, small_splits):
    logs = open_logs(spark, f"file:{folder}", default_year=2024)
    once = logs.decoded()
    key = F.struct("file", "pos", F.to_json(F.struct("line", "timestamp", "level", "source", "message", "fields", "raw", "parse_error")))
    same = lambda a, b: sorted(map(str, a.select(key).collect())) == sorted(map(str, b.select(key).collect()))
    for given in ({}, {"keep_rejected": True}, {"raw_filter": F.col("raw").contains("5")}, {"last": 7}, {"last": 2, "keep_rejected": True}):
        assert same(logs.entries(**given), once.entries(**given))
    assert same(logs.number(logs.entries()), once.number(once.entries())) and same(logs.warnings(), once.warnings())
    assert "jsontostructs" not in once.entries()._jdf.queryExecution().toString()
    for fmt in ("json", "csv", "raw"):
        counts = [export(source, f"file:{tmp_path}-{fmt}{k}", fmt, search="1", ordered=True) for k, source in enumerate((logs, once))]
        texts = ["".join(part.read_text() for part in sorted(type(tmp_path)(f"{tmp_path}-{fmt}{k}").glob("part-*"))) for k in (0, 1)]
        assert counts[0] == counts[1]
        assert sorted(set(texts[0].splitlines())) == sorted(set(texts[1].splitlines()))


def test_export_in_order(spark, folder, tmp_path, small_splits):
    logs = open_logs(spark, f"file:{folder}/b.log")
    export(logs, f"file:{tmp_path}/o", "raw", ordered=True)
    text = "".join(part.read_text() for part in sorted((tmp_path / "o").glob("part-*")))
    assert text == TEXT


def test_csv_sink(spark, folder, tmp_path):
    entries = read_logs(spark, f"file:{folder}/a.json")
    assert field_keys(entries) == ["ip", "status"]
    write_csv(entries.coalesce(1), f"file:{tmp_path}/o")
    lines = next((tmp_path / "o").glob("part-*")).read_text().splitlines()
    assert lines[0] == "line,timestamp,level,source,message,ip,status"
    assert '3,2024-01-15T08:24:01Z,ERROR,,"Redis, failed",10.0.0.2,500' in lines


def test_csv_sink_renames_taken_names(spark, folder, tmp_path):
    entries = read_logs(spark, f"file:{folder}/a.json").withColumn("fields", F.create_map(F.lit("Level"), F.lit("x"), F.lit("k"), F.lit(" y ")))
    write_csv(entries, f"file:{tmp_path}/o")
    rows = spark.read.csv(f"file:{tmp_path}/o", header=True)
    assert rows.columns[5:] == ["fields.Level", "k"] and rows.select("k").head().k == " y "


def test_parquet_sink_prunes_by_date(spark, folder, tmp_path):
    write_parquet(read_logs(spark, f"file:{folder}"), f"file:{tmp_path}/p")
    kept = spark.read.parquet(f"file:{tmp_path}/p").where("date = '2024-01-15' and level = 'FATAL'")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(level,FATAL)" in plan
    assert kept.count() == 1


def test_report_sinks(spark, folder, tmp_path):
    rows = aggregate(open_logs(spark, f"file:{folder}/a.json"), group_by="status", top_ips=5)
    assert write_report_csv(rows, f"file:{tmp_path}/r") == ["level", "group", "ip", "error"]
    level = spark.read.csv(f"file:{tmp_path}/r/level", header=True)
    assert level.columns == ["level", "count"] and level.count() == 3
    assert spark.read.csv(f"file:{tmp_path}/r/group", header=True).columns == ["status", "count"]
    assert spark.read.csv(f"file:{tmp_path}/r/ip", header=True).columns == ["ip", "requests"]
    write_report_json(rows, f"file:{tmp_path}/j")
    whole = "".join(part.read_text() for part in sorted((tmp_path / "j").glob("part-*")))
    assert json.loads(whole)["summary"]["matched_entries"] == 4


def test_same_entries_in_any_zone(spark, folder):
    before = spark.conf.get("spark.sql.session.timeZone")
    seen = []
    for zone in ("UTC", "America/Los_Angeles"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        logs = open_logs(spark, f"file:{folder}", default_year=2024)
        seen.append(sorted(map(str, aggregate(logs, time_from="2024-01-15T08:02:00Z", top_ips=3).collect())))
    spark.conf.set("spark.sql.session.timeZone", before)
    assert seen[0] == seen[1]


@pytest.mark.parametrize(("name", "fmt", "text"), [("a", "json", JSON), ("b", "text", TEXT), ("c", "csv", CSV), ("d", "syslog", SYSLOG)])
def test_stream_equals_batch(spark, tmp_path, name, fmt, text):
    source = tmp_path / "in"
    source.mkdir()
    write_file(source / name, text)
    header = text.splitlines()[0].split(",") if fmt == "csv" else None
    columns = ("timestamp", "level", "source", "message", "raw")
    stream = follow(spark, f"file:{source}", fmt, header=header, default_year=2024).select(*columns)
    query = start_query(stream, checkpoint=f"file:{tmp_path}/check", available_now=True)
    query.format("parquet").option("path", f"file:{tmp_path}/out").start().awaitTermination()
    got = spark.read.parquet(f"file:{tmp_path}/out").collect()
    want = open_logs(spark, f"file:{source}", fmt, default_year=2024).entries().select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_follow_picks_up_new_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_file(source / "1", "2024-01-15 08:00:00 ERROR timeout one\n2024-01-15 08:00:00 INFO timeout\n")
    stream = follow(spark, f"file:{source}", "text", search="TIMEOUT", level="error").select("message")
    out = f"file:{tmp_path}/out"

    def run():
        query = start_query(stream, checkpoint=f"file:{tmp_path}/check", available_now=True)
        query.format("parquet").option("path", out).start().awaitTermination()
        return sorted(r.message for r in spark.read.parquet(out).collect())

    assert run() == ["timeout one"]
    write_file(source / "2", "2024-01-15 08:00:00 ERROR timeout two\n\n")
    assert run() == ["timeout one", "timeout two"]


def test_follow_since(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_file(source / "1", "old\n")
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=1)
    for since, n in ((later, 0), (later - dt.timedelta(hours=2), 1)):
        stream = follow(spark, f"file:{source}", "text", since=since).select("message")
        query = start_query(stream, checkpoint=f"file:{tmp_path}/check{n}", available_now=True)
        rows = []
        query.foreachBatch(lambda batch, _: rows.extend(batch.collect())).start().awaitTermination()
        assert len(rows) == n
    with pytest.raises(ValueError):
        follow(spark, f"file:{source}", "text", since=dt.datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        follow(spark, f"file:{source}", "auto")


def test_running_counts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_file(source / "1", TEXT)
    counts = running_level_counts(follow(spark, f"file:{source}", "text"))
    final = {}
    query = start_query(counts, "update", checkpoint=f"file:{tmp_path}/check", available_now=True)
    query.foreachBatch(lambda batch, _: final.update({r.level: r["count"] for r in batch.collect()})).start().awaitTermination()
    assert final == {"ERROR": 86, "INFO": 514}


def test_json_sink_keeps_zero_values_out(spark, tmp_path):
    entries = read_logs(spark, write_file(tmp_path / "t", "plain line\n"), "text")
    write_json(entries, f"file:{tmp_path}/o")
    assert _json_rows(tmp_path / "o") == [{"line": 1, "message": "plain line"}]


def test_recognition_of_many_small_files(spark, tmp_path):
    """Hundreds of files a task, and one row for the driver where all are alike."""
    for i in range(5000):
        (tmp_path / f"{i}.log").write_text(f"<{11 + i % 4}>Jan 15 08:00:00 host app[{i}]: said {i}\n")
    files = listed_files(spark, str(tmp_path))
    heads = file_heads(spark, str(tmp_path), files)
    assert heads.rdd.getNumPartitions() < 100
    logs = open_logs(spark, str(tmp_path))
    assert [(b.fmt, b.paths) for b in logs.branches] == [("syslog", [str(tmp_path)])]
    (tmp_path / "0.log").write_text('{"level": "info"}\n')
    assert {b.fmt: len(b.paths) for b in open_logs(spark, str(tmp_path)).branches} == {"json": 1, "syslog": 4999}


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "\n\nb", "1\n" * 10, "1\n" * 10 + "x", "1\n" * 40, "y" * 40_000 + "\n2\n3"])
def test_first_lines(tmp_path, text):
    path = tmp_path / "f"
    path.write_text(text)
    lines = text.split("\n")
    whole = lines[:-1] if not lines[-1] else lines
    assert [line.decode() for line in first_lines(str(path))] == whole[:10]


@pytest.mark.parametrize("fmt", ["json", "auto", "csv"])
def test_files_are_chosen_before_they_are_opened(spark, tmp_path, fmt):
    """By path and by time; what is not chosen is not read, and every job sees the same files."""
    for i in range(6):
        lines = CSV if fmt == "csv" else JSON
        (tmp_path / f"{'api' if i % 2 else 'web'}-{i}.log").write_text(lines)
        os.utime(tmp_path / f"{'api' if i % 2 else 'web'}-{i}.log", (1_700_000_000 + i, 1_700_000_000 + i))
    at = lambda s: dt.datetime.fromtimestamp(1_700_000_000 + s, dt.timezone.utc)
    logs = open_logs(spark, str(tmp_path), fmt, files="/api-", modified_from=at(2), modified_to=at(5))
    names = {f"api-{i}.log" for i in (3, 5)}
    scan = logs.entries().select("raw")
    scan.collect()
    read = [n for n in _nodes(scan._jdf.queryExecution().executedPlan()) if n.metrics().contains("numFiles")]
    assert [n.metrics().apply("numFiles").value() for n in read] == [2]
    for rows in (analyze(logs), analyze(logs, limit=1000), tail_logs(logs, 1000)):
        assert {r.file.rsplit("/", 1)[1] for r in rows.collect()} == names
    assert analyze(open_logs(spark, str(tmp_path), fmt, files="/none")).count() == 0
    with pytest.raises(ValueError):
        open_logs(spark, str(tmp_path), fmt, modified_from=dt.datetime(2024, 1, 1))


def _nodes(plan):
    """The scans of an executed plan."""
    found, left = [], [plan]
    while left:
        node = left.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
            continue
        found.append(node)
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return found
