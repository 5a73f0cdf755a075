"""Substring deduplication with longest-previous-factor arrays over suffix arrays.

A byte repeats if a string of LENGTH bytes that covers it also starts elsewhere, in the same text or another. Texts are UTF-8
bytes; matches never cross texts.

1. Equal texts are one: a text that occurs twice repeats as a whole, the first of them stands for all.
2. Every string of LENGTH bytes has an anchor: the least hash of the grams of GRAM bytes in it, the first on a tie. Equal
   strings have equal anchors at equal places, so consecutive starts with one anchor form a run, and runs with the same anchor
   hash are all that ever need to meet. Anchors that come once are dropped after a count.
3. Runs of the same bytes around the anchor are equal whole (by a 128-bit hash). What is left are the distinct runs of an
   anchor. Many of them (over GROUP, a passage in many surroundings) are cut: starts are dealt into blocks by their distance
   from the anchor, and the bytes that all strings of a block share (its core) take the anchor's place. Blocks shrink until a
   core is the whole string, so any number of runs is split up and no group is met whole.
4. Groups are concatenated up to BATCH bytes, and their suffix array is built by prefix doubling. Previous and next smaller
   places in suffix order give each start its longest previous factor and where that stands: an earlier match of LENGTH bytes
   or more makes the start's bytes a later copy. The source of a factor is the string's first copy, or itself a later one; so
   factors and sources together are all copies.

``keep_first`` removes later copies (by doc_id, then place) and keeps the first; otherwise all copies go.

Defined cases: null and empty texts have no bytes, nothing is removed from them; null doc_ids come first; rows that share doc_id
and text are one text with ``keep_first`` (it stays in each of them if it is the first) and copies of each other without; texts
of any length are cut into pieces of PIECE bytes that overlap by a string; an empty table gives an empty result; other columns
come back as they were, but for ``spans`` and ``kept``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallylog.llm.common import checked, written

LENGTH = 400
GRAM = 64
#: Distinct runs of one anchor that are compared in one suffix array, at most.
GROUP = 512
#: Bytes of a suffix array, about; and bytes of a text that are hashed at a time. Few enough for a processor's cache.
BATCH = 1 << 16
PIECE = 1 << 17
#: Starts per block where an anchor has too many runs, round by round.
BLOCKS = (64, 8, 1)
#: Bytes whose order starts the prefix doubling (9 bits each in a 64-bit number).
FIRST = 7

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
RUN = "at long, starts int, reach int, token long, same binary"
#: A run: starts at .. at + starts - 1, anchor ``reach`` bytes behind the first of them.


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, base, np.uint64))])


class _Hashes:
    """Hashes of all grams of a buffer, from running sums (modulo 2**64)."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grams(self, data: np.ndarray, size: int) -> np.ndarray:
        n = len(data)
        if len(self.up) <= n:
            self.up = _powers(int(_BASE), n)
            self.down = _powers(pow(int(_BASE), -1, 1 << 64), n)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n])])
            hashes = (sums[size:] - sums[:-size]) * self.down[: n - size + 1]
            hashes ^= hashes >> np.uint64(32)
            hashes *= _MIX
            hashes ^= hashes >> np.uint64(29)
        return hashes


_hashes = _Hashes()


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Per start of a string of ``length`` bytes: the place of its anchor; and the hashes of all grams."""
    hashes = _hashes.grams(data, gram)
    low = np.uint64((1 << 24) - 1)
    ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    return (sliding_least(ranked, length - gram + 1) & low).astype(np.int64), hashes


def _runs_of(buffer: bytes, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Iterator[tuple]:
    """(text number, at, starts, reach, token, same) of texts that lie end to end in a buffer below 16 MB."""
    data = np.frombuffer(buffer, np.uint8)
    if len(data) < length:
        return
    place, hashes = anchors(data, length, gram)
    owner = np.repeat(np.arange(len(starts)), ends - starts)[: len(place)]
    inside = np.arange(len(place)) + length <= ends[owner]
    border = np.ones(len(place), bool)
    border[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    number = np.cumsum(border)[inside]
    if not len(number):
        return
    where = np.flatnonzero(inside)
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    count = np.diff(np.append(first, len(number)))
    at = where[first]
    tokens = hashes[place[at]].view(np.int64)
    for k, n, anchor, token in zip(at.tolist(), count.tolist(), place[at].tolist(), tokens.tolist(), strict=True):
        same = xxhash.xxh3_128_digest(buffer[k : k + n - 1 + length])
        own = int(owner[k])
        yield own, k - int(starts[own]), n, anchor - k, token, same


def _find_runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, hashes = batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("of").to_pylist()
        held: list[tuple[int, int, bytes]] = []  # row, offset in its text, bytes
        size = 0

        def found(held):
            ends = np.cumsum([len(x) for _, _, x in held])
            out = []
            for own, at, n, reach, token, same in _runs_of(b"".join(x for _, _, x in held), ends - [len(x) for _, _, x in held], ends, length, gram):
                row, offset, _ = held[own]
                out.append((ids[row], hashes[row], offset + at, n, reach, token, same))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for row in range(batch.num_rows):
            text = texts[row].as_py().encode() if texts[row].is_valid else b""
            if len(text) < length:
                continue
            for offset in range(0, len(text) - length + 1, PIECE):
                held.append((row, offset, text[offset : offset + PIECE + length - 1]))
                size += len(held[-1][2])
                if size >= PIECE:
                    yield found(held)
                    held, size = [], 0
        if held:
            yield found(held)


def suffix_order(data: np.ndarray, enough: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order of their first bytes (``enough``, or until all differ) and the ranks by FIRST, 3 * FIRST, ... bytes.

    ``data`` is bytes plus 1, or 0 between texts. Ranks past the end are 0. Three ranks make the next number to sort by, two
    where there are too many suffixes for that.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.int64), np.zeros(FIRST, np.int64)])
    key = np.zeros(n, np.int64)
    size = max(1, min(FIRST, enough))
    for k in range(size):
        key = (key << 9) | padded[k : n + k]
    levels = []
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        levels.append((size, rank))
        if size >= enough or rank[order[-1]] == n:
            return order, levels
        parts = 3 if n + 1 < 1 << 21 else 2
        # the last ranks may overlap those before them, which are equal where the last ones decide
        longer = min(parts * size, enough)
        key = rank
        for k in range(1, parts):
            key = key * (n + 1)
            step = min(k * size, longer - size)
            if step < n:
                key[: n - step] += rank[step:]
        size = longer


def common_prefix(data: np.ndarray, one: np.ndarray, two: np.ndarray, levels: list[tuple[int, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at two lists of places share, at most ``most`` each."""
    n = len(data)
    one, two, shared = one.copy(), two.copy(), np.zeros(len(one), np.int64)
    for size, rank in levels[::-1]:
        while True:
            fits = (one < n) & (two < n) & (shared + size <= most)
            fits[fits] = rank[one[fits]] == rank[two[fits]]
            if not fits.any():
                break
            step = np.where(fits, size, 0)
            one, two, shared = one + step, two + step, shared + step
    for _ in range(FIRST - 1):
        fits = (one < n) & (two < n) & (shared < most)
        fits[fits] = data[one[fits]] == data[two[fits]]
        one, two, shared = one + fits, two + fits, shared + fits
        if not fits.any():
            break
    return shared


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """Per element the index of the nearest smaller one before it, -1 without; by following such links until none moves."""
    link = np.arange(-1, len(values) - 1)
    moving = np.flatnonzero((link >= 0) & (values[link] > values))
    while len(moving):
        link[moving] = link[link[moving]]
        moving = moving[(link[moving] >= 0) & (values[link[moving]] > values[moving])]
    return link


def previous_factors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Per place of ``starts`` (rising) the longest previous factor and its place; factors begin at earlier places of ``starts``.

    Texts end before ``ends``. Suffixes are told apart by ``length`` bytes; of longer matches any may be named. With ``whole``
    only factors of ``length`` bytes are wanted: those that are longer are named as such, and those that are shorter are not.
    """
    order, levels = suffix_order(data, length)
    valid = np.zeros(len(data), bool)
    valid[starts] = True
    chosen = order[valid[order]]
    n = len(chosen)
    before = _smaller_before(chosen)
    after = n - 1 - _smaller_before(chosen[::-1])[::-1]
    longest, source = np.zeros(len(data), np.int64), np.full(len(data), -1)
    room = np.zeros(len(data), np.int64)
    room[starts] = ends - starts
    for link in (before, after):
        has = (link >= 0) & (link < n)
        own, other = chosen[has], chosen[link[has]]
        most = np.minimum(room[own], room[other])
        if whole:  # equal ranks by the last level: as many equal bytes, unless it tells all apart
            rank = levels[-1][1]
            shared = np.where((rank[own] == rank[other]) & (most >= length), length, 0)
        else:
            shared = common_prefix(data, own, other, levels, most)
        better = shared > longest[own]
        longest[own[better]], source[own[better]] = shared[better], other[better]
    return longest[starts], source[starts]


def repeats(runs: list[tuple[bytes, int]], length: int, keep_first: bool) -> list[list[tuple[int, int]]]:
    """Spans to remove from each of ``runs`` (bytes, number of starts), which are in order of their first places."""
    sizes = np.array([len(text) + 1 for text, _ in runs])
    begins = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.int64)
    raw = np.frombuffer(b"\x00".join(text for text, _ in runs) + b"\x00", np.uint8)
    data[:] = raw.astype(np.int64) + 1
    data[begins + sizes - 1] = 0
    starts = np.concatenate([np.arange(b, b + n) for b, (_, n) in zip(begins.tolist(), runs, strict=True)])
    ends = np.repeat(begins + sizes - 1, [n for _, n in runs])
    # every start of a longer match has a factor of its own
    longest, source = previous_factors(data, starts, ends, length, whole=True)
    later = longest >= length
    marks = np.zeros(len(data) + 1, np.int64)
    np.add.at(marks, starts[later], 1)
    np.add.at(marks, starts[later] + longest[later], -1)
    if not keep_first:
        np.add.at(marks, source[later], 1)
        np.add.at(marks, source[later] + longest[later], -1)
    covered = np.concatenate([[False], np.cumsum(marks[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    out: list[list[tuple[int, int]]] = [[] for _ in runs]
    owner = np.searchsorted(begins, edges[::2], "right") - 1
    for k, a, b in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out[k].append((a - int(begins[k]), b - int(begins[k])))
    return out


def _compare(batches: Iterator[pa.RecordBatch], schema: pa.Schema, length: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Rows of runs with their bytes, sorted by token and first place, to spans; groups stay whole."""
    held: list[dict] = []
    size, token = 0, None

    def found() -> pa.RecordBatch:
        out = []
        spans = repeats([(row["bytes"], row["starts"]) for row in held], length, keep_first)
        for row, own in zip(held, spans, strict=True):
            out += [{"doc_id": row["doc_id"], "of": row["of"], "start": row["at"] + a, "end": row["at"] + b} for a, b in own]
        return pa.RecordBatch.from_pylist(out, schema)

    for batch in batches:
        for row in batch.to_pylist():
            if held and size >= BATCH and row["token"] != token:
                yield found()
                held, size = [], 0
            held.append(row)
            token = row["token"]
            size += len(row["bytes"])
    if held:
        yield found()


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema, length: int, block: int) -> Iterator[pa.RecordBatch]:
    """Runs with their bytes to smaller ones: starts by their distance from the anchor, the core's hash for token."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            text, reach = row["bytes"], row["reach"]
            # start k of the run lies reach - k bytes before the anchor; the blocks are counted from there
            k = 0
            while k < row["starts"]:
                number = (reach - k) // block
                n = min(row["starts"], reach - number * block + 1) - k
                core = text[reach - number * block : reach - number * block - block + 1 + length]
                token = xxhash.xxh3_64_intdigest(core + b"%d %d" % (number, row["token"])) - (1 << 63)
                same = xxhash.xxh3_128_digest(text[k : k + n - 1 + length])
                own = text[k : k + n - 1 + length]
                out.append({"doc_id": row["doc_id"], "of": row["of"], "at": row["at"] + k, "starts": n, "reach": reach - k, "token": token, "same": same, "bytes": own})
                k += n
        yield pa.RecordBatch.from_pylist(out, schema)


def _with_bytes(runs: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """``runs`` with the bytes they cover. Texts are shuffled for it at every size, once: they grow with the corpus."""
    lists = runs.groupBy("doc_id", "of").agg(F.collect_list(F.struct("at", "starts", "reach", "token", "same", "runs")).alias("own"))
    lists = lists.select(F.col("doc_id").alias("i"), F.col("of").alias("o"), "own")
    texts = docs.select("doc_id", "of", "text").join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("of") == F.col("o")))
    each = texts.select("doc_id", "of", F.encode("text", "UTF-8").alias("whole"), F.explode("own").alias("run"))
    return each.selectExpr("doc_id", "of", "run.*", f"substring(whole, CAST(run.at AS int) + 1, run.starts - 1 + {length}) AS bytes")


def _arrow(df: DataFrame, shape: str) -> pa.Schema:
    return to_arrow_schema(df.sparkSession.createDataFrame([], shape).schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, of (xxhash64 of the text), start, end: spans of bytes to remove, which may overlap."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("of"))
    span, run = f"doc_id {kind}, of long, start long, end long", f"doc_id {kind}, of long, {RUN}"
    span_schema, run_schema = _arrow(docs, span), _arrow(docs, run)

    # equal texts: the first row stands for all of them
    long_enough = texts.where(F.octet_length("text") >= length)
    of_two = F.xxhash64(F.lit(1), "text")
    rows = long_enough.groupBy("of", of_two.alias("of_two")).agg(F.min(F.struct("doc_id")).alias("first"), F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).cast("long").alias("size"))
    several = rows.where("n > 1").select(F.col("of").alias("copied"), F.col("of_two").alias("copied_two"), F.col("first.doc_id").alias("first"), "size")
    several = checked(written(several, "copied-texts"), 200_000)
    equal_text = (F.col("of") == F.col("copied")) & (of_two == F.col("copied_two"))
    copies = texts.join(several, equal_text)
    other = ~F.col("doc_id").eqNullSafe(F.col("first"))
    gone = copies.where(other) if keep_first else copies
    out = [gone.select("doc_id", "of", F.lit(0).cast("long").alias("start"), F.col("size").alias("end")).distinct()]
    single = long_enough.join(several, equal_text & other, "left_anti")

    runs = written(single.mapInArrow(lambda batches: _find_runs(batches, run_schema, length, gram), run), "runs")
    cut_schema = _arrow(docs, f"{run}, bytes binary")
    for block in (*(size for size in BLOCKS if 2 * size <= length), 0):
        tokens = runs.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        shared = checked(written(tokens.where("n > 1").select("token"), "shared-anchors"))
        met = written(runs.join(shared, "token", "left_semi"), "shared-runs")
        firsts = F.min(F.struct("doc_id", "of", "at", "starts", "reach")).alias("first")
        sets = written(met.groupBy("token", "same").agg(F.count(F.lit(1)).alias("n"), firsts), "distinct-runs")
        # equal runs repeat whole; but for the first of them, where that is to stay
        equal = checked(sets.where("n > 1").select("token", "same", "first"), 100_000)
        again = met.join(equal, ["token", "same"])
        is_first = F.struct("doc_id", "of", "at").eqNullSafe(F.struct("first.doc_id", "first.of", "first.at"))
        if keep_first:
            again = again.where(~is_first)
        out.append(again.selectExpr("doc_id", "of", "at AS start", f"at + starts - 1 + {length} AS end"))
        # runs that differ: a suffix array, or smaller blocks
        per = written(sets.groupBy("token").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1"), "differing-anchors")
        if per.isEmpty():
            break
        heads = sets.join(checked(per), "token")
        if "bytes" in met.columns:  # blocks have kept theirs
            heads = met.join(heads.select("token", "same", "first", "runs"), ["token", "same"]).where(is_first).dropDuplicates(["token", "same"])
        else:
            heads = _with_bytes(heads.selectExpr("token", "same", "first.*", "runs"), texts, length)
        heads = written(heads.select("doc_id", "of", "at", "starts", "reach", "token", "same", "runs", "bytes"), "differing-runs")
        few = heads.where(F.col("runs") <= group).repartition("token").sortWithinPartitions("token", "doc_id", "of", "at")
        spans = few.select("doc_id", "of", "at", "starts", "token", "bytes").mapInArrow(lambda batches: _compare(batches, span_schema, length, keep_first), span)
        out.append(written(spans, "factor-spans"))
        many = heads.where(F.col("runs") > group).drop("runs")
        if not block or many.isEmpty():
            break
        runs = written(many.mapInArrow(lambda batches, block=block: _cut(batches, cut_schema, length, block), f"{run}, bytes binary"), "cut-runs")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _removed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept = [], []
        for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = (text.as_py() or "").encode()
            merged: list[dict] = []
            for start, end in sorted((s["start"], s["end"]) for s in found.as_py() or ()):
                if merged and start <= merged[-1]["end"]:
                    merged[-1]["end"] = max(end, merged[-1]["end"])
                else:
                    merged.append({"start": start, "end": end})
            edges = [0, *(x for s in merged for x in (s["start"], s["end"])), len(data)]
            spans.append(merged)
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        made = {"spans": pa.array(spans, schema.field("spans").type), "kept": pa.array(kept, pa.binary())}
        done = dict(zip(batch.schema.names, batch.columns, strict=True)) | made
        yield pa.RecordBatch.from_arrays([done[name] for name in schema.names], names=schema.names)


def without_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, **bounds: int) -> DataFrame:
    """``docs`` with ``spans`` (maximal removed runs of bytes, in order) and ``kept`` (the bytes that stay)."""
    found = repeated_spans(docs, length, keep_first, **bounds)
    lists = found.groupBy("doc_id", "of").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    lists = lists.selectExpr("doc_id AS span_id", "of AS span_of", "spans")
    plain = docs.drop("spans", "kept")
    keys = F.struct(*(F.col(c) for c in plain.columns)).alias("row")
    rows = plain.select(keys, F.xxhash64("text").alias("of"))
    joined = rows.join(lists.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("span_id")) & (F.col("of") == F.col("span_of")), "left").select("row.*", "spans")
    shape = joined.withColumn("kept", F.lit(b""))
    schema = to_arrow_schema(shape.schema)
    return joined.mapInArrow(lambda batches: _removed(batches, schema), shape.schema)
