"""Ranges of files: line borders, ends and beginnings of files, and lines appended while a stream runs."""

from __future__ import annotations

import random

import pytest

from tallylog import analyze, open_logs, tail_logs
from tallylog.sources import ranges
from tallylog.streaming import appended, follow_appended, start_query


def test_each_line_is_in_one_range(tmp_path):
    rng = random.Random(2)
    for trial in range(30):
        parts = [bytes(rng.choice(b"ab \r") for _ in range(rng.choice([0, 1, 5, 40, 70_000 if trial == 0 else 9]))) for _ in range(rng.randrange(1, 30))]
        data = b"\n".join(parts) + (b"\n" if trial % 2 else b"")
        path = tmp_path / f"{trial} a%20b.log"
        path.write_bytes(data)
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(rng.randrange(12)))})
        got = [line for a, b in zip(cuts, cuts[1:]) for line in ranges.range_lines(str(path), a, b)]
        want = data.split(b"\n")
        assert got == (want[:-1] if not want[-1] else want)


def test_names_of_files():
    assert ranges.open_file("file:///tmp/a%20b%25.log")[1] == "/tmp/a b%.log"
    assert ranges.open_file("/tmp/a%20b")[1] == "/tmp/a%20b"
    assert ranges.seekable("file:/x/y.log") and not ranges.seekable("/x/y.log.gz") and not ranges.seekable("viewfs://store/x")


@pytest.fixture
def big_file(tmp_path):
    lines = [f"2024-01-15 08:00:00 {'ERROR' if k % 1000 == 7 else 'INFO'} message {k} {'x' * 80}" for k in range(60_000)]
    for k in range(59_000, 60_000, 3):
        lines[k] = " \t"
    (tmp_path / "a.log").write_text("\n".join(lines))
    (tmp_path / "b.log").write_text("only line\r\n\n")
    (tmp_path / "c.log").write_text("")
    return tmp_path, lines


def test_tail_reads_the_ends_only(spark, big_file):
    folder, lines = big_file
    want = [line.split(" ", 3)[3] for line in lines if line.strip()]
    for n in (1, 3, 5000):
        rows = tail_logs(open_logs(spark, f"file:{folder}", "text"), n).collect()
        assert [r.message for r in rows] == want[-n:] + ["only line"]
    windows = ranges.tail_lines(spark, f"file:{folder}/a.log", 10)
    # as many bytes as the first window, of more than five million
    assert windows.agg({"pos.block": "min"}).first()[0] >= (folder / "a.log").stat().st_size - ranges.FIRST_BYTES


def test_head_stops_early(spark, big_file):
    folder, lines = big_file
    logs = open_logs(spark, f"file:{folder}", "text")
    from tallylog import build_filter

    chosen = build_filter(level="ERROR")
    rows, used = logs.first(4, chosen.on_raw, chosen.on_entry)
    assert [r.line for r in rows.collect()] == [8, 1008, 2008, 3008]
    assert sum(stop - start for _, start, stop in used) == 1 << 20 < (folder / "a.log").stat().st_size / 4
    every = analyze(logs, level="ERROR", limit=100).collect()
    assert [r.line for r in every] == list(range(8, 59_000, 1000)) + [k + 1 for k in range(59_007, 60_000, 1000) if lines[k].strip()]
    assert [r.line for r in analyze(logs, limit=59_999).collect()][-1] == 1
    assert analyze(logs, search="nowhere", limit=3).count() == 0


def test_compressed_files_are_scanned(spark, tmp_path):
    import gzip

    (tmp_path / "a.log.gz").write_bytes(gzip.compress("".join(f"line {k}\n" for k in range(50)).encode()))
    logs = open_logs(spark, f"file:{tmp_path}", "text")
    assert [r.message for r in tail_logs(logs, 2).collect()] == ["line 48", "line 49"]
    assert [r.line for r in analyze(logs, limit=2).collect()] == [1, 2]


def test_appended_lines_come_once(spark, tmp_path):
    folder, target = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()
    (folder / "a.log").write_text("old one\nbegun")
    (folder / ".hidden").write_text("no\n")
    entries = follow_appended(spark, str(folder), "text").select("file", "message")
    options = {"checkpoint": str(tmp_path / "state")}

    def delivered():
        return sorted(r.message for r in spark.read.schema("file string, message string").parquet(str(target)).collect())

    running = start_query(entries, **options).format("parquet").option("path", str(target)).start()
    try:
        running.processAllAvailable()
        with (folder / "a.log").open("a") as file:
            file.write(" before\nnew one\r\n\npart")
        (folder / "b.log").write_text("another file\n")
        running.processAllAvailable()
        assert delivered() == ["another file", "begun before", "new one"]
    finally:
        running.stop()
    # goes on from its checkpoint; a file cut short and one replaced by a longer one are read from their starts
    with (folder / "a.log").open("a") as file:
        file.write(" done\n")
    (folder / "b.log").write_text("cut\n")
    running = start_query(entries, available_now=True, **options).format("parquet").option("path", str(target)).start()
    running.awaitTermination()
    (folder / "b.log").write_text("replaced by more\nthan before\n")
    running = start_query(entries, available_now=True, **options).format("parquet").option("path", str(target)).start()
    running.awaitTermination()
    assert delivered() == ["another file", "begun before", "cut", "new one", "part done", "replaced by more", "than before"]


def test_offsets_and_ranges_of_appended_files(tmp_path, monkeypatch):
    (tmp_path / "a.log").write_bytes(b"one\ntwo\nthree")
    (tmp_path / "b.txt").write_bytes(b"x\n")
    reader = appended.AppendedReader(str(tmp_path / "*.log"), True)
    start = reader.initialOffset()
    assert [place[0] for place in start["files"].values()] == [8]
    with (tmp_path / "a.log").open("ab") as file:
        file.write(b"\n" + b"four\n" * 50)
    monkeypatch.setattr(appended, "RANGE_BYTES", 64)
    parts = reader.partitions(start, reader.latestOffset())
    assert len(parts) > 2
    lines = [value for part in parts for batch in reader.read(part) for value in batch.column("value").to_pylist()]
    assert lines == [b"three"] + [b"four"] * 50
