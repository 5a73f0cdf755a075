"""Benchmark decontamination by SimHash windows, with DataFrame operations only.

A document is contaminated by a benchmark item if a window of it, as long in words as the item, has a weighted Jaccard
similarity of PERCENT or more with the item: shingles of SHINGLE words (of all words if the item is shorter), weighted by how
often each occurs; words are split at white space and lower-cased in A-Z.

1. A window without shingles of the benchmark has similarity 0, and one that reaches the threshold holds at least
   ``2 p / (100 + p)`` of its own among the benchmark's. Shingles are looked up in the benchmark (broadcast behind a check of
   its size, else shuffled), and windows with too few hits are ruled out before anything is fingerprinted: no loss.
2. The other windows get a 64-bit SimHash of their words. All fingerprints of items of that length within RADIUS are found by
   a multi-index: 8 blocks of 8 bits; of two fingerprints at most 15 bits apart some block differs in one bit or none, so items
   are filed under every block value and its eight neighbours and windows look up their own eight.
3. Pairs within the radius are verified by the exact weighted similarity. Those of the remaining windows and items that lie
   further apart but share shingles are verified as exactly, from the shingles they share: no window is left to the radius.

Defined cases: null, empty and blank texts, and items without words, match nothing; repeated items and documents are found
each; ties of similarity go to the earliest window. Rows that share a doc_id but not the text are told apart by the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.functions.text import fence
from tallylog.llm.common import checked, lower_ascii, words_of, written

SHINGLE = 5
PERCENT = 75
RADIUS = 15


def _shingle(words: str, width: int) -> str:
    at = ", ".join(f"element_at({words}, i + {k})" for k in range(width))
    return f"transform(sequence(1, size({words}) - {width - 1}), i -> xxhash64({at}))"


def _shingles(words: str) -> Column:
    """The shingle hashes of a sequence of words; a shorter sequence is one shingle."""
    short = F.when(F.size(words) == 0, F.expr("CAST(array() AS array<bigint>)"))
    for width in range(1, SHINGLE):
        short = short.when(F.size(words) == width, F.expr(_shingle(words, width)))
    return short.otherwise(F.expr(_shingle(words, SHINGLE)))


def _fingerprint(words: str) -> str:
    """64 bits: bit b is set if more word hashes have it than not. Every occurrence of a word counts."""
    ones = "size(filter(hs, h -> shiftright(h, b) & 1L = 1L))"
    return f"aggregate(sequence(0, 63), 0L, (acc, b) -> IF(2 * {ones} > size(hs), acc | shiftleft(1L, b), acc))".replace("hs", f"{words}_hashes")


def _weighted_similarity(one: str, two: str) -> str:
    """Sum of the smaller counts over the sum of the larger, from sorted distinct shingles and all shingles."""
    count = lambda of: f"size(filter({of}, y -> y = x))"
    shared = f"aggregate(transform(array_intersect({one}, {two}), x -> least({count(one)}, {count(two)})), 0, (a, n) -> a + n)"
    return f"{shared}"


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), shingles and fingerprint of every item with words."""
    items = benchmark.select("item_id", words_of(lower_ascii(F.col("text"))).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("w_hashes", F.transform("w", lambda x: F.xxhash64(x)))
    return items.select("item_id", F.size("w").alias("n"), _shingles("w").alias("item_shingles"), F.expr(_fingerprint("w")).alias("item_print"))


def _counted(shingles: str) -> str:
    """A row per distinct shingle, with how often it occurs."""
    return f"inline(transform(array_distinct({shingles}), x -> named_struct('h', x, 'times', size(filter({shingles}, y -> y = x)))))"


def _beyond(windows: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start, shared and total of windows and items that share shingles and lie beyond the radius."""
    by_item = items.selectExpr("item_id", "n AS item_n", "item_print", "xxhash64(item_shingles) AS item_of", _counted("item_shingles"))
    by_item = written(by_item.withColumnsRenamed({"h": "item_h", "times": "item_times"}).distinct(), "item-counts")
    own = windows.selectExpr("doc_id", "of", "n", "start", "print", "size(shingles) AS size", _counted("shingles"))
    both = own.join(checked(by_item), (F.col("h") == F.col("item_h")) & (F.col("n") == F.col("item_n")) & F.expr(f"bit_count(print ^ item_print) > {RADIUS}"))
    shared = both.groupBy("doc_id", "of", "start", "size", "item_id", "item_of").agg(F.sum(F.least("times", "item_times")).alias("shared"))
    return shared.selectExpr("doc_id", "item_id", "start", "shared", "2 * size - shared AS total")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity and word_start of the best window for every document and item that match."""
    items = written(benchmark_items(benchmark), "items")
    known = written(items.select(F.explode("item_shingles").alias("h"), "n").groupBy("h").agg(F.collect_set("n").alias("lengths")), "item-shingles")
    widths = sorted(row[0] for row in items.select(F.least("n", F.lit(SHINGLE))).distinct().collect())

    # fenced: a filter above must not split the texts again
    texts = fence(docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("of"), words_of(lower_ascii(F.col("text"))).alias("w")), "w")
    by_width = [
        texts.where(F.size("w") >= width).select("doc_id", "of", F.size("w").alias("words"), F.lit(width).alias("width"), F.posexplode(F.expr(_shingle("w", width))).alias("at", "h"))
        for width in widths or [SHINGLE]
    ]
    hashed = by_width[0]
    for other in by_width[1:]:
        hashed = hashed.unionByName(other)
    hits = hashed.join(checked(known), "h").select("doc_id", "of", "words", "width", "at", F.explode("lengths").alias("n")).where(f"least(n, {SHINGLE}) = width")
    # a hit at ``at`` lies in the windows that start up to n - width before it
    starts = hits.selectExpr("doc_id", "of", "n", "width", "explode(sequence(greatest(0, at - n + width), least(at, words - n))) AS start")
    full = starts.where("start >= 0").groupBy("doc_id", "of", "n", "width", "start").count()
    full = full.where(f"count * {100 + PERCENT} >= 2 * {PERCENT} * (n - width + 1)").select("doc_id", "of", "n", "start")
    places = written(full.groupBy("doc_id", "of").agg(F.collect_list(F.struct("n", "start")).alias("places")), "windows")

    at = docs.select("doc_id", "text", F.xxhash64("text").alias("of")).join(checked(places), ["doc_id", "of"])
    at = at.select("doc_id", "of", words_of(lower_ascii(F.col("text"))).alias("words"), "places").distinct()
    # cut the windows out before they become rows: a row never repeats the document
    cut = "inline(transform(places, p -> named_struct('n', p.n, 'start', p.start, 'w', slice(words, p.start + 1, p.n))))"
    windows = at.selectExpr("doc_id", "of", cut)
    windows = windows.withColumn("w_hashes", F.transform("w", lambda x: F.xxhash64(x)))
    windows = windows.select("doc_id", "of", "n", "start", _shingles("w").alias("shingles"), F.expr(_fingerprint("w")).alias("print"))
    windows = written(windows, "prints")

    blocks = "posexplode(transform(sequence(0, 7), b -> shiftright(print, 8 * b) & 255L)) AS (block, value)"
    filed = items.selectExpr("item_id", "n AS item_n", "item_shingles", "item_print", blocks.replace("print", "item_print").replace("value)", "own)"))
    filed = filed.selectExpr("item_id", "item_n", "item_shingles", "item_print", "block AS item_block", "explode(concat(array(own), transform(sequence(0, 7), b -> own ^ shiftleft(1L, b)))) AS item_value")
    looked = windows.selectExpr("*", blocks)
    near = looked.join(
        checked(written(filed, "item-index"), 200_000),
        (F.col("n") == F.col("item_n")) & (F.col("block") == F.col("item_block")) & (F.col("value") == F.col("item_value")) & F.expr(f"bit_count(print ^ item_print) <= {RADIUS}"),
    )
    pairs = near.dropDuplicates(["doc_id", "start", "item_id", "print"])
    shared = pairs.withColumn("shared", F.expr(_weighted_similarity("shingles", "item_shingles"))).withColumn("total", F.expr("size(shingles) + size(item_shingles)") - F.col("shared"))
    shared = shared.select("doc_id", "item_id", "start", "shared", "total").unionByName(_beyond(windows, items))
    best = shared.where(f"100 * shared >= {PERCENT} * total").groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("total")).alias("similarity"), (-F.col("start")).alias("back"))).alias("b"))
    return best.selectExpr("doc_id", "item_id", "b.similarity AS similarity", "CAST(-b.back AS bigint) AS word_start")
