"""Token ids as compressed binary blocks with a shared dictionary.

Format. A folder with two tables: ``dictionary`` (one row: hash, bytes) and ``blocks``. A block is one binary value:

    8 bytes   magic ``TIDS\\x01\\0\\0\\0``
    8 bytes   xxh64 of the dictionary the frames need (0: none)
    8 bytes   number of documents n
    n x 24    offset index: doc_id (signed), byte offset of the frame behind the index, number of ids; 64-bit little-endian
    ...       n zstandard frames, each a document's ids as little-endian unsigned 32-bit integers

so a short document is read by its index entry and one frame, without its neighbours. Beside the block stand the part and
block number in doc_id order, the first and last doc_id and the number of ids, by which Parquet skips blocks. Blocks are rows
of an ordinary Spark table: any store that Spark reaches holds them, and a task that is lost is written again.

The dictionary is trained on the ids of at most SAMPLE documents (those with the smallest hash of doc_id and text length), cut to
SAMPLE_BYTES each; it affects the size alone, never the ids. Nulls are empty texts, which hold the end id; repeated rows are
kept; an empty table has no block. A document of any length is a frame of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import checked, written
from tallylog.llm.tokens import batches_of
from tallylog.plans.scratch import scratch_dir

MAGIC = b"TIDS\x01\0\0\0"
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 65_536, 65_536
LEVEL = 3
#: A block closes once its frames reach this size.
BLOCK_BYTES = 4 << 20
#: Input bytes of a written part, about.
PART_CHARS = 16 << 20


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = 0) -> bytes:
    """A dictionary for the ids of ``docs``; empty if there is too little to learn from."""
    cut = docs.select("doc_id", F.substring("text", 1, SAMPLE_BYTES // 2).alias("text"))
    # the hash is a column, else every comparison of two rows would work it out again from their texts
    sample = cut.select("text", F.xxhash64("doc_id", F.length("text")).alias("place")).orderBy("place").limit(SAMPLE).select("text")
    samples = [ids[:SAMPLE_BYTES] for ids in batches_of([row.text for row in sample.toLocalIterator()], end_id, tokenizer)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_block(rows: list[tuple[int | None, int, bytes]], dictionary: bytes) -> bytes:
    """(doc_id, number of ids, frame) as one block."""
    index, at = [], 0
    for doc, count, frame in rows:
        # a null doc_id shows in a negative number of ids
        index.append(struct.pack("<qqq", doc or 0, at, -1 - count if doc is None else count))
        at += len(frame)
    head = MAGIC + struct.pack("<QQ", xxhash.xxh64_intdigest(dictionary) if dictionary else 0, len(rows))
    return b"".join([head, *index, *(frame for _, _, frame in rows)])


def read_block(data: bytes, dictionary: bytes) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, number of ids, ids) of every document of a block."""
    if data[:8] != MAGIC:
        raise ValueError("not a block of token ids")
    digest, count = struct.unpack_from("<QQ", data, 8)
    if digest != (xxhash.xxh64_intdigest(dictionary) if dictionary else 0):
        raise ValueError("the block needs another dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    body, view = 24 + 24 * count, memoryview(data)
    entries = [struct.unpack_from("<qqq", data, 24 + 24 * k) for k in range(count)]
    ends = [body + entry[1] for entry in entries[1:]] + [len(data)]
    for (doc, at, length), end in zip(entries, ends, strict=True):
        if length < 0:
            doc, length = None, -1 - length
        yield doc, length, reader.decompress(view[body + at : end], max_output_size=4 * length)


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> None:
    """Writes the ids of all ``docs`` (doc_id, text) below ``folder``, in ascending doc_id order over parts and blocks."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id)
    spark.createDataFrame([(f"{xxhash.xxh64_intdigest(dictionary):016x}" if dictionary else "", dictionary)], "hash string, bytes binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES
    names = ["part", "block", "first_doc", "last_doc", "n_ids", "data"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(given) if given else None)
        rows, size, block, part = [], 0, 0, None

        def close() -> pa.RecordBatch:
            values = [part, block, rows[0][0], rows[-1][0], sum(row[1] for row in rows), write_block(rows, given)]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, [pa.int64()] * 5 + [pa.binary()], strict=True)], names=names)

        for batch in batches:
            docs_, parts = batch.column("doc_id").to_pylist(), batch.column("part")
            for k, ids in enumerate(batches_of((x.as_py() for x in batch.column("text")), end_id, tokenizer)):
                part = parts[k].as_py()
                frame = packer.compress(ids)
                rows.append((docs_[k], len(ids) // 4, frame))
                size += len(frame)
                if size >= BLOCK_BYTES:
                    yield close()
                    rows, size, block = [], 0, block + 1
        if rows:
            yield close()

    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ordered = docs.select("doc_id", "text").repartitionByRange(max(1, -(-chars // PART_CHARS)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(encode, "part long, block long, first_doc long, last_doc long, n_ids long, data binary").write.parquet(f"{folder}/blocks")


def read_ids(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids) of every document written below ``folder``."""
    dictionary = spark.read.parquet(f"{folder}/dictionary").first()["bytes"]
    shared = spark.sparkContext.broadcast(bytes(dictionary))
    blocks = spark.read.parquet(f"{folder}/blocks")
    # the ids before a block: over parts (one row each), then within its part
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS before_part")
    starts = blocks.join(parts, "part").selectExpr("before_part + sum(n_ids) OVER (PARTITION BY part ORDER BY block) - n_ids AS before", "part", "block")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        for batch in batches:
            for before, data in zip(batch.column("before").to_pylist(), batch.column("data"), strict=True):
                rows = []
                for doc, length, ids in read_block(data.as_py(), given):
                    rows.append((doc, before, length, zlib.crc32(ids), ids))
                    before += length
                yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)], names=names)

    placed = blocks.select("part", "block", "data").join(checked(written(starts, "token-starts")), ["part", "block"])
    return placed.select("before", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the ids of ``docs`` to a fresh shared folder and reads them back."""
    folder = scratch_dir(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, folder, end_id)
    return read_ids(docs.sparkSession, folder)

