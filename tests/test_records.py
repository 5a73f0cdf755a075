"""CSV records over splits against one walk over the whole file."""

from __future__ import annotations

import csv
import io
import random

import pytest

from tallylog import analyze, export, open_logs
from tallylog.sources import records


def test_ranges_hold_each_record_once(tmp_path):
    rng = random.Random(3)
    for trial in range(60):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        rows = [["".join(rng.choice('ab ,"\n\r') for _ in range(rng.randrange(6))) + "." for _ in range(3)] for _ in range(rng.randrange(1, 20))]
        writer.writerows(rows)
        data = out.getvalue().encode()
        if trial % 3 == 0:
            data = data.rstrip()
        if trial % 4 == 0:  # quotes that are text, and a value that never ends
            data = data.replace(b"a,", b'a"b,').replace(b" ,", b' "x" y,') + b'"open,\n'
        path = tmp_path / f"{trial}.csv"
        path.write_bytes(data)
        whole = records.record_values(str(path), 0, len(data), len(data), records.RECORD)
        if trial % 4:
            assert whole == [_line(row) for row in rows]
        for step in (1, 2, 3, 7, len(data)):
            state, got = records.RECORD, []
            for start in range(0, len(data), step):
                stop = min(len(data), start + step)
                got += records.record_values(str(path), start, stop, len(data), state)
                state, _ = records.walk(data[start : stop + 2], state, stop - start, stop == len(data))
            assert got == whole, (trial, step)


def _line(row):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(row)
    return out.getvalue().encode()


@pytest.mark.parametrize("range_bytes", [64, 1 << 20])
def test_multiline_files(spark, tmp_path, monkeypatch, range_bytes):
    rows = [(f"2024-01-15T08:00:{k % 60:02}Z", "error" if k % 3 else "info", f'line {k}\nand, "more"\r\n' if k % 2 else f"plain {k}") for k in range(300)]
    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\n")
    writer.writerow(["timestamp", "level", "message"])
    for k, row in enumerate(rows):
        writer.writerow(row if k != 17 else (*row, "too many"))
        if k % 50 == 0:
            text.write("\n")
    (tmp_path / "a.csv").write_bytes(text.getvalue().encode())
    monkeypatch.setattr(records.csv_record_lines, "__defaults__", (range_bytes,))
    logs = open_logs(spark, f"file:{tmp_path}/a.csv", "csv", multiline_csv=True)
    got = logs.number(logs.entries()).orderBy("line").collect()
    assert [(r.line, r.message) for r in got] == [(k + 2, row[2]) for k, row in enumerate(rows) if k != 17]
    assert logs.warnings().count() == 1
    assert logs._branch_rows(logs.branches[0]).select("pos.block").distinct().count() > (5 if range_bytes == 64 else 0)
    assert [r.line for r in analyze(logs, level="ERROR", limit=2).collect()] == [3, 4]
