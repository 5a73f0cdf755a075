"""b-bit MinHash near-duplicate detection.

Method: 128 minima per set of word shingles; their low bits are packed into a signature, from which the similarity of two
sets is estimated by counting equal bits, corrected for chance agreement; bands of four minima give the candidates.

1. One pass hashes words (JVM) and computes set size, set fingerprint, signature and band keys (numpy on Arrow batches).
2. Texts with equal sets form a class at once, represented by its smallest doc_id.
3. Representatives that share a band key with the smallest one in its bucket form candidate clusters (linear in rows: a
   bucket gives a star, never all its pairs).
4. A cluster is cut into blocks of at most 2 x BLOCK texts (each pair of blocks meets once), so no task holds a cluster. In
   a block a pair whose estimate is within reach, or one with a set of fewer than SMALL shingles and sizes within reach, is
   confirmed on the full sets; a pair already connected needs no test.
5. Components of the confirmed links.

Nulls, empty and blank texts have an empty set and no link. A text of fewer words than a shingle is one shingle. Rows that
share a doc_id are one node, linked by whichever row links; each row gets its own result row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylog.llm.common import checked, lower_ascii, words_of, written

SHINGLE = 5
PERCENT = 75
MINIMA, BANDS, BITS = 128, 32, 2
#: Texts of one side of a block.
BLOCK = 256
#: An estimate so many standard errors below the threshold rules a pair out (chance below 1e-6 for a true link). That takes
#: agreement by chance averaged over many minima; in a set of fewer than SMALL shingles few make all of them.
SIGMAS = 5
SMALL = 32

_rng = np.random.RandomState(20240501)
_XOR = _rng.randint(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)[:, None]
_MULTIPLY = (_rng.randint(0, 1 << 31, MINIMA, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SIGNED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("signature", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a sequence of word hashes."""
    if not len(words):
        return np.empty(0, np.uint64)
    words = words.view(np.uint64)
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        out = out * _K1 + words[i : len(words) - width + 1 + i]
    return np.unique(_mix(out))


def minima(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1024):
        np.minimum(best, ((low[k : k + 1024] ^ _XOR) * _MULTIPLY).min(axis=1), out=best)
    return best


def _signature(best: np.ndarray) -> bytes:
    """The low BITS bits of every minimum, packed: all first bits, then all second bits."""
    return np.packbits(np.concatenate([(best >> np.uint32(b)) & np.uint32(1) for b in range(BITS)]).astype(np.uint8)).tobytes()


def _band_keys(best: np.ndarray) -> np.ndarray:
    rows = best.astype(np.uint64).reshape(BANDS, -1)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _K3
    for i in range(rows.shape[1]):
        key = _mix(key * _K1 + rows[:, i])
    return key.view(np.int64)


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets = _lists(batch.column("words"))
        counts, first, second, signatures, bands = [], [], [], [], []
        for start, end in zip(offsets[:-1], offsets[1:], strict=True):
            shingles = shingle_set(values[start:end])
            counts.append(len(shingles))
            if len(shingles):
                best = minima(shingles)
                first.append(int(_mix(shingles ^ _K1).sum().view(np.int64)))
                second.append(int(_mix(shingles + _K2).sum().view(np.int64)))
                signatures.append(_signature(best))
                bands.append(_band_keys(best))
            else:
                first.append(0)
                second.append(0)
                signatures.append(b"")
                bands.append(np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=SIGNED.names)


def hashed_words(docs: DataFrame) -> DataFrame:
    """doc_id and the hashes of the lower-cased words of the text."""
    lowered = docs.select("doc_id", words_of(lower_ascii(F.col("text"))).alias("words"))
    return lowered.select("doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set fingerprint (set_a, set_b), packed signature and band keys, a row per document."""
    return hashed_words(docs).mapInArrow(_sign, SIGNED)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Alternates large and small stars until nothing changes, each round written to the shared folder. A hub's neighbours are
    only ever reduced to their minimum, which combines before the shuffle.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.withColumnRenamed("m", "b")).distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _agreement(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Estimated similarity of all rows of two arrays of unpacked signatures (rows, BITS, MINIMA) of 0 and 1."""
    equal = np.zeros((len(one), len(two)), np.float32)
    # a position agrees if all its bits do: one product per value of the bits
    for value in range(1 << BITS):
        hit = [np.all([part[:, b] == ((value >> b) & 1) for b in range(BITS)], axis=0).astype(np.float32) for part in (one, two)]
        equal += hit[0] @ hit[1].T
    chance = 0.5**BITS
    return (equal / MINIMA - chance) / (1 - chance)


def _cut() -> float:
    chance = 0.5**BITS
    agree = chance + (1 - chance) * PERCENT / 100
    return PERCENT / 100 - SIGMAS * (agree * (1 - agree) / MINIMA) ** 0.5 / (1 - chance)


def block_links(ids: list[int], sides: list[int], sizes: list[int], packed: list[bytes], words: list[np.ndarray], same: bool) -> list[tuple[int, int]]:
    """Confirmed links of a block, as a forest: enough links to connect whatever is connected within it."""
    order = sorted(range(len(ids)), key=lambda i: (sides[i], ids[i]))
    ids, packed, words = [ids[i] for i in order], [packed[i] for i in order], [words[i] for i in order]
    counts = np.array([sizes[i] for i in order], np.int64)
    border = sum(1 for i in order if sides[i] == 0) if not same else len(ids)
    bits = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(ids), -1), axis=1).reshape(len(ids), BITS, MINIMA)
    left, right = (bits, bits) if same else (bits[:border], bits[border:])
    rows, columns = (counts, counts) if same else (counts[:border], counts[border:])
    least, most = np.minimum.outer(rows, columns), np.maximum.outer(rows, columns)
    near = ((_agreement(left, right) >= _cut()) | (least < SMALL)) & (100 * least >= PERCENT * most)
    if same:
        near = np.triu(near, 1)
    sets: dict[int, set[int]] = {}
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def held(i: int) -> set[int]:
        if i not in sets:
            sets[i] = set(shingle_set(words[i]).tolist())
        return sets[i]

    links = []
    for x, y in zip(*(part.tolist() for part in np.nonzero(near)), strict=True):
        y += 0 if same else border
        if (rx := root(x)) == (ry := root(y)):
            continue
        one, two = held(x), held(y)
        shared = len(one & two)
        if 100 * shared >= PERCENT * (len(one) + len(two) - shared):
            parent[rx] = ry
            links.append((ids[x], ids[y]))
    return links


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal (cluster, i, j), sorted; yields the links of each."""
    key, held = None, ([], [], [], [], [])
    out: list[tuple[int, int]] = []

    def close() -> None:
        if key is not None and len(held[0]) > 1:
            out.extend(block_links(*held, same=key[1] == key[2]))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        out.clear()
        return batch

    for batch in batches:
        values, offsets = _lists(batch.column("words"))
        columns = [batch.column(name).to_pylist() for name in ("cluster", "i", "j", "doc_id", "side", "n_shingles", "signature")]
        for row, (cluster, i, j, doc, side, size, signature) in enumerate(zip(*columns, strict=True)):
            if (cluster, i, j) != key:
                close()
                key, held = (cluster, i, j), ([], [], [], [], [])
            for part, value in zip(held, (doc, side, size, signature, values[offsets[row] : offsets[row + 1]].copy()), strict=True):
                part.append(value)
        if out:
            yield flush()
    close()
    if out:
        yield flush()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for every row of ``docs`` (doc_id, text)."""
    signed = written(signatures(docs.select("doc_id", "text")), "signatures")
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("class"))
    members = filled.select("doc_id", "set_a", "set_b", "n_shingles").distinct().join(classes, ["set_a", "set_b", "n_shingles"])
    copies = members.where("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))

    chosen = classes.select(F.col("class").alias("doc_id"), "set_a", "set_b")
    heads = filled.join(chosen, ["doc_id", "set_a", "set_b"], "left_semi").select("doc_id", "set_a", "n_shingles", "signature", "bands")
    keys = heads.select("doc_id", F.explode("bands").alias("band"))
    stars = keys.withColumn("leader", F.expr("first(doc_id) OVER (PARTITION BY band ORDER BY doc_id)"))
    clusters = written(components(stars.where("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))), "clusters")

    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = written(clusters.join(sizes, "component").join(heads.withColumnRenamed("doc_id", "node"), "node").selectExpr("node AS doc_id", "set_a", "n_shingles", "signature", "component AS cluster", "blocks", "CAST(pmod(xxhash64(node, set_a), blocks) AS int) AS block").dropDuplicates(["doc_id", "set_a"]), "placed")
    # the words of a row follow only if the row is a representative: its id and fingerprint-free text may repeat, which is harmless
    texts = hashed_words(docs.select("doc_id", "text").join(checked(placed.select("doc_id").distinct()), "doc_id", "left_semi"))
    dealt = placed.join(texts, "doc_id").selectExpr("*", "explode(sequence(0, blocks - 1)) AS other").selectExpr("cluster", "least(block, other) AS i", "greatest(block, other) AS j", "doc_id", "IF(block <= other, 0, 1) AS side", "n_shingles", "signature", "words")
    links = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_confirm, "a long, b long")

    found = written(components(copies.unionByName(links)), "components")
    return signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))
