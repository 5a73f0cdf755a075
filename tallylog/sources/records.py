"""Records of CSV files whose quoted values may hold line breaks, from splits of the files.

Where a split begins, nobody knows yet whether that is inside quotes. So every range of a file is walked once for each state it
may be entered in, which gives a table from entry to exit states; the tables of a file are followed in order, and then each
range yields the records that begin in it. A quote opens a value at its start (white space may precede it) and closes it before
a comma, a line end or the end of the file; a doubled quote is one of the value, and any other quote is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.plans.scratch import written
from tallylog.sources.ranges import MOST_TASKS, RANGE_BYTES, as_lines, file_sizes, open_file, seekable

#: States between two bytes: at the start of a record, at that of a value (or in white space there), in plain text, inside
#: quotes, and inside quotes before the second of two quotes.
RECORD, START, PLAIN, QUOTED, DOUBLED = range(5)
_SPECIAL = re.compile(rb'[",\n]')
_CHUNK = 1 << 16
_LINES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("value", pa.binary())])


def walk(data: bytes, state: int, stop: int, last: bool) -> tuple[int, list[int]]:
    """The state behind ``stop`` bytes and the places behind the line feeds that end records before it.

    ``data`` goes on behind ``stop`` by two bytes, unless ``last`` says that the file ends with it.
    """
    ends: list[int] = []
    quoted, skip, field, plain = state in (QUOTED, DOUBLED), 0 if state == DOUBLED else -1, 0, state == PLAIN
    for found in _SPECIAL.finditer(data, 0, stop):
        at = found.start()
        if at == skip:
            continue
        char = data[at]
        if quoted:
            if char == 34:
                after = data[at + 1 : at + 3]
                if after[:1] == b'"':
                    skip = at + 1
                elif after[:1] in (b",", b"\n", b"") or after == b"\r\n" or (after == b"\r" and last):
                    quoted, plain, field = False, True, at + 1
        elif char == 34:
            if not plain and not data[field:at].strip(b" \t"):
                quoted = True
            else:
                plain = True
        else:
            plain, field = False, at + 1
            if char == 10:
                ends.append(at + 1)
    if quoted:
        return (DOUBLED if skip == stop else QUOTED), ends
    if plain or data[field:stop].strip(b" \t"):
        return PLAIN, ends
    return (RECORD if ends and ends[-1] == stop else START), ends


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            size = row["stop"] - row["start"]
            system, path = open_file(row["file"])
            with system.open_input_file(path) as source:
                source.seek(row["start"])
                data = source.read(size + 2)
            exits = [walk(data, state, size, row["stop"] == row["size"])[0] for state in range(5)]
            rows.append(row | {"exits": exits})
        yield pa.RecordBatch.from_pylist(rows, _EXITS)


_EXITS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("size", pa.int64()), ("exits", pa.list_(pa.int32()))])


def _entered(ranges: pd.DataFrame) -> pd.DataFrame:
    ranges = ranges.sort_values("start")
    state, states = RECORD, []
    for exits in ranges["exits"]:
        states.append(state)
        state = exits[state]
    return ranges[["file", "start", "stop", "size"]].assign(state=states)


def record_values(file: str, start: int, stop: int, size: int, state: int) -> list[bytes]:
    """The records that begin in [start, stop) of a file entered in ``state``, without blank ones."""
    system, path = open_file(file)
    length = stop - start
    with system.open_input_file(path) as source:
        source.seek(start)
        data = source.read(length + 2)
        inside, ends = walk(data, state, length, stop == size)
        begins = ([0] if state == RECORD else []) + [end for end in ends if end < length]
        if not begins:
            return []
        # the last record that begins here may end far behind the range
        data, at = data[:length], size if inside == RECORD else stop
        while at < size:
            source.seek(at)
            more = source.read(_CHUNK + 2)
            room = min(_CHUNK, size - at)
            inside, found = walk(more, inside, room, at + room == size)
            data += more[: found[0]] if found else more[:room]
            if found:
                break
            at += room
    borders = [*begins, len(data)]
    values = [data[a:b].rstrip(b"\n") for a, b in zip(borders, borders[1:])]
    values = [value[:-1] if value.endswith(b"\r") else value for value in values]
    return [value for value in values if value.strip()]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            values = record_values(row["file"], row["start"], row["stop"], row["size"], row["state"])
            for at in range(0, len(values), 10_000):
                some = values[at : at + 10_000]
                columns = [[row["file"]] * len(some), [row["start"]] * len(some), list(range(at, at + len(some))), some]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINES)], schema=_LINES)


def csv_record_lines(
    spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES, *, on_file: Column | None = None
) -> DataFrame | None:
    """The records of CSV files as ``file``, ``pos``, ``value``, the header left out; None if a file has no ranges.

    The header begins in the first range of its file.
    """
    sizes = written(file_sizes(spark, paths, on_file).where("size > 0"), "csv-files")
    if any(not seekable(row["file"]) for row in sizes.select("file").toLocalIterator()):
        return None
    ranges = sizes.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("file", "start", F.least(F.col("start") + range_bytes, "size").alias("stop"), "size")
    tasks = int(min(MOST_TASKS, ranges.count() or 1))
    known = ranges.repartition(tasks).mapInArrow(_exits, "file string, start long, stop long, size long, exits array<int>")
    # a row of a few numbers per range; a file of a terabyte has some hundred thousand
    entered = known.groupBy("file").applyInPandas(_entered, "file string, start long, stop long, size long, state int")
    entered = written(entered, "csv-ranges")
    lines = as_lines(entered.repartition(tasks).mapInArrow(_records, "file string, block bigint, seq bigint, value binary"))
    return lines.where((F.col("pos.block") > 0) | (F.col("pos.seq") > 0))
