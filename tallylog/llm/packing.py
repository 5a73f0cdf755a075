"""Best-fit packing of token pieces into sequences of a fixed capacity, as hierarchical residual packing.

Every partition packs its own items best-fit (longest first, each into the fullest bin that takes it). Bins that are nearly
full are final. The others go on as items of their fill into the next round, over fewer partitions, until one task has seen
all that are left, or a round no longer joins bins. A task holds at most about ITEMS items, each a few numbers, so the
partition count follows the number of items; a level's placements are written, so a lost executor costs one task.

Repeated rows and equal lengths are told apart by an item number. Null and empty texts hold the end id alone. Pieces must not
be longer than the capacity; an empty table gives no sequence. Other columns of the documents are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import written
from tallylog.llm.tokens import batches_of, encoder

CAPACITY = 4096
#: Items a task packs at once, on average.
ITEMS = 50_000
#: A bin filled to this share is final.
FULL = 0.99


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False, release: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit) for every piece of every document.

    ``release``: a task gives back its worker's chunks at its end, for sessions whose other Python jobs share the workers.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # some hundred documents at a time, and ids only if asked for: workers share the executor's memory
        for batch in (whole.slice(at, 250) for whole in batches for at in range(0, whole.num_rows, 250)):
            rows: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for doc, data in zip(ids, batches_of((x.as_py() for x in batch.column("text")), end_id, tokenizer), strict=True):
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)], names=names)
        if release:
            encoder(tokenizer).forget()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every item, given longest first, and the fill of every bin.

    Bins stand in stacks by the room left. The set bits of ``rooms`` name the stacks that hold a bin, so the fullest bin with
    room for an item is the lowest bit from the item's length on.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, offsets, fills = 0, [], [], []
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(fills)
            fills.append(0)
        bins.append(chosen)
        offsets.append(fills[chosen])
        fills[chosen] += length
        room -= length
        if room:
            stacks[room].append(chosen)
            rooms |= 1 << room
    return bins, offsets, fills


def _pack_partition(capacity: int, names: list[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        items = pa.Table.from_batches(held).sort_by([("length", "descending"), ("item", "ascending")]).combine_chunks()
        bins, offsets, fills = best_fit(items.column("length").to_pylist(), capacity)
        bins = np.array(bins, np.int64)
        keys = items.column("item").to_numpy()
        first = np.full(len(fills), -1, np.int64)
        first[bins[::-1]] = keys[::-1]  # a bin is named by the first item in it
        added = {"bin": first[bins], "offset": np.array(offsets, np.int64), "fill": np.array(fills, np.int64)[bins]}
        out = pa.table([items.column(n) for n in names] + [pa.array(v, pa.int64()) for v in added.values()], names=names + list(added))
        yield from out.to_batches(max_chunksize=10_000)

    return pack


def pack(items: DataFrame, capacity: int = CAPACITY, per_task: int = ITEMS) -> DataFrame:
    """``items`` (a column length, and any others) with sequence_id and offset: where each lies, gapless from 0."""
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "pack-items")
    level, maps, before = items, [], None
    while True:
        count = level.count()
        parts = max(1, -(-count // per_task))
        schema = level.schema.simpleString()[7:-1] + ",bin:bigint,offset:bigint,fill:bigint"
        placed = written(level.repartition(parts, "item").mapInArrow(_pack_partition(capacity, level.columns), schema.replace(":", " ")), "pack-round")
        maps.append(placed)
        # joined nothing that earlier rounds had left: more rounds would not either
        if parts == 1 or (before is not None and count > 0.99 * before):
            break
        before = count
        level = placed.where((F.col("item") == F.col("bin")) & (F.col("fill") < FULL * capacity)).select("item", F.col("fill").alias("length"))
    names = items.columns
    placed = maps[0].select(*names, F.col("bin").alias("sequence_id"), "offset")
    moved = None
    for upper in reversed(maps[1:]):
        step = upper.select(F.col("item").alias("of"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        moved = step if moved is None else _moved(step.withColumnsRenamed({"to": "sequence_id", "by": "offset"}), moved, ["of"]).withColumnsRenamed({"sequence_id": "to", "offset": "by"})
    return (placed if moved is None else _moved(placed, moved, names)).drop("item")


def _moved(placed: DataFrame, moved: DataFrame, names: list[str]) -> DataFrame:
    """Placements in bins of one round as placements in the bins that took those up later."""
    joined = placed.join(moved.withColumnsRenamed({"of": "_of", "to": "_to", "by": "_by"}), F.col("sequence_id") == F.col("_of"), "left")
    return joined.select(*names, F.coalesce("_to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset"))


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids (binary) of the packed sequences, from placements that carry ids. A sequence is one bounded row."""
    ordered = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
