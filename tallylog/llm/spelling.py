"""Spelling variants of a corpus' words: pairs one edit apart by a variable-length gram index, grouped under the usual form.

1. ``corpus_words``: the runs of letters of all whole texts, counted; words of MIN_CHARS code points or more that occur MIN_COUNT
   times or more stay.
2. ``frequent_grams``, the gram dictionary: the grams of 2 to MAX_GRAM - 1 characters, of words between two border marks, that
   more than a limit of words hold. The limit is at least LIST and rises with the corpus, so that at most DICTIONARY
   grams can pass it; these are broadcast.
3. ``grams``, the decomposition: at every place of a word the gram starts with 2 characters and is made longer while it is
   frequent, up to MAX_GRAM. Whether it grows is read off its own characters alone, so an edit affects just the grams that
   hold the edited place. The most grams that one edit of a word can affect is the word's bound.
4. ``near_pairs``, list merging: two words one edit apart share every gram that the edit does not affect. Each word sends
   its bound + 1 rarest grams; the first shared gram in that order is among them on both sides, whatever the edit is. Rarity is
   a level per bucket of gram hashes, from the words that hold the grams: a table of BUCKETS bytes, whatever the input. A list
   holds the words of a gram, its place and the text on one side of it (the edit is on one side only, so the other is
   equal), by word length.
5. Candidates with too many letters of their own are dropped by the parities of their letters, as an edit changes two at
   most; the others are verified by their edit distance.

As MAX_GRAM is MIN_CHARS or less, the first and the last gram of a word never hold the same place: every word has a gram that
an edit leaves alone, and no pair is lost.

Defined cases: null and empty texts have no words; a null doc_id is an empty one in ``changed``; texts may be of any length, a
text is never held but by its own row; rows that share a doc_id count as often as they are there; an empty table gives no
words; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import lower_ascii, written

#: Fixed value: letters that make up a word.
LETTERS = r"[A-Za-zÀ-ÿ]+"
MIN_CHARS = 5
MIN_COUNT = 3
MAX_GRAM = 5
#: A gram of more words than this is frequent, at least; and so many grams are frequent, at most.
LIST = 64
DICTIONARY = 50_000
BUCKETS = 1 << 16
#: A form is so many times as frequent as its variant, at least.
TIMES = 2


def corpus_words(docs: DataFrame, change=None, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n (occurrences) over the whole texts of ``docs``; ``change`` may rewrite a run (a column of a row with doc_id)."""
    runs = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(LETTERS), 0)
    words = docs.select("doc_id", F.explode(runs).alias("word"))
    if change is not None:
        words = words.select(change(F.col("doc_id"), F.col("word")).alias("word"))
    counts = words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


def _marked(word: str) -> str:
    return f"\x02{word}\x03"


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, words (that hold it), for all grams of 2 to MAX_GRAM characters; a written table."""
    marked = F.concat(F.lit("\x02"), "word", F.lit("\x03"))
    each = [F.expr(f"transform(sequence(1, length(m) - {size - 1}), i -> substr(m, i, {size}))") for size in range(2, MAX_GRAM + 1)]
    held = words.select(marked.alias("m")).select(F.explode(F.array_distinct(F.concat(*each))).alias("gram"))
    return written(held.groupBy("gram").agg(F.count(F.lit(1)).alias("words")), "grams")


def frequent_grams(counts: DataFrame, least: int = LIST, most: int = DICTIONARY) -> frozenset[str]:
    """The grams that more words hold than a limit; never more than ``most``, as the limit rises with their number."""
    shorter = counts.where(F.length("gram") < MAX_GRAM)
    total = shorter.agg(F.sum("words")).first()[0] or 0
    limit = max(least, total // most)
    return frozenset(row.gram for row in shorter.where(F.col("words") > limit).select("gram").toLocalIterator())


def rarity_levels(counts: DataFrame) -> bytes:
    """A level per bucket of gram hashes: BUCKETS bytes."""
    bucket = F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(BUCKETS)).alias("bucket")
    sums = counts.groupBy(bucket).agg(F.floor(8 * F.log2(F.sum("words"))).alias("level"))
    levels = bytearray(BUCKETS)
    for row in sums.collect():
        levels[row.bucket] = min(row.level, 255)
    return bytes(levels)


def grams(word: str, frequent: frozenset[str]) -> list[str]:
    """The gram at every place of a word between its marks but the last."""
    marked = _marked(word)
    out = []
    for at in range(len(marked) - 1):
        size = 2
        while size < MAX_GRAM and at + size < len(marked) and marked[at : at + size] in frequent:
            size += 1
        out.append(marked[at : at + size])
    return out


def bound(pieces: list[str]) -> int:
    """The most grams that one edit affects: those that hold a place."""
    holding = [0] * (len(pieces) + 1)
    for at, piece in enumerate(pieces):
        for place in range(at, at + len(piece)):
            holding[place] += 1
    return max(holding[1:-1])  # the marks are never edited


def sent_grams(word: str, frequent: frozenset[str], levels: bytes) -> list[tuple[int, str]]:
    """(place, gram) of a word's rarest grams, as many as its bound and one more."""
    pieces = grams(word, frequent)
    order = sorted((levels[zlib.crc32(piece.encode()) % BUCKETS], piece, at) for at, piece in enumerate(pieces))
    return [(at, piece) for _, piece, at in order[: bound(pieces) + 1]]


def lists_of(word: str, sent: list[tuple[int, str]]) -> list[str]:
    """The lists of grams and the text on one side; none where nothing is left on the other side to edit."""
    marked = _marked(word)
    before = [f"{len(gram)}<{marked[: at + len(gram)]}" for at, gram in sent if at + len(gram) < len(marked)]
    return before + [f"{len(gram)}>{marked[at:]}" for at, gram in sent if at > 0]


def letter_parities(word: str) -> int:
    """A bit per kind of letter that occurs an odd number of times (some letters share one)."""
    bits = 0
    for letter in word:
        bits ^= 1 << ord(letter) % 61
    return bits


def _rows(frames: Iterator[pd.DataFrame], known) -> Iterator[pd.DataFrame]:
    frequent, levels = known.value
    for frame in frames:
        out = []
        for word, n in zip(frame["word"], frame["n"], strict=True):
            bits = letter_parities(word)
            for name in lists_of(word, sent_grams(word, frequent, levels)):
                # a hash of the list and the length stands for them: what falls together with another is verified away
                own, longer = (xxhash.xxh3_64_intdigest(f"{size}:{name}") - (1 << 63) for size in (len(word), len(word) + 1))
                out.append((word, n, bits, own, longer))
        yield pd.DataFrame(out, columns=["word", "n", "bits", "list", "longer"])


def near_pairs(words: DataFrame, least: int = LIST, most: int = DICTIONARY) -> DataFrame:
    """word, n, other, other_n: the pairs of ``words`` (a written table) one edit apart, once."""
    counts = gram_counts(words)
    known = words.sparkSession.sparkContext.broadcast((frequent_grams(counts, least, most), rarity_levels(counts)))
    lists = written(words.mapInPandas(lambda frames: _rows(frames, known), "word string, n long, bits long, list long, longer long"), "gram-lists")
    held = lists.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("bits").alias("other_bits"), "list")
    # of two words of one length the greater probes; a shorter one probes the lists of the next length
    probes = lists.select("word", "n", "bits", F.explode(F.array("list", "longer")).alias("list"))
    apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("other_bits"))) <= 2
    met = probes.join(held, (probes["list"] == held["list"]) & apart & ((F.length("word") < F.length("other")) | (F.col("word") > F.col("other"))))
    return met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of a written table (word, form): what following forms leads to.

    A form is TIMES as frequent as its word, so a way is no longer than the binary digits of a count; each round doubles
    the steps taken.
    """
    ways = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = written(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ways = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return ways


def variants(words: DataFrame, least: int = LIST, most: int = DICTIONARY) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n; distinct words of MIN_CHARS or more)."""
    words = written(words.select("word", "n"), "words")
    pairs = written(near_pairs(words, least, most), "near-words")
    back = pairs.selectExpr("other AS word", "other_n AS n", "word AS other", "n AS other_n")
    alone = words.selectExpr("word", "n", "CAST(null AS string) AS other", "CAST(null AS long) AS other_n")
    usual = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))))
    best = alone.unionByName(pairs).unionByName(back).groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), usual.alias("usual"))
    fits = -F.col("usual.less") >= TIMES * F.col("n")
    found = best.select("word", "n", "n_near", F.when(fits, F.col("usual.other")).alias("form"), F.when(fits, -F.col("usual.less")).alias("form_n"))
    found = written(found, "forms")
    led = roots(found.where("form IS NOT NULL"))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def changed(doc_id: Column, run: Column, every: int = 97) -> Column:
    """The run without one code point, where ``every`` divides the crc32 of ``<doc_id>:<run>``: planted misspellings."""
    code = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = F.pmod(code, F.length(run).cast("long")).cast("int")
    less = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(code % every == 0, less).otherwise(run)
