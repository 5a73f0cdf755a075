"""Quality rules with adaptive thresholds.

Instead of fixed cutoffs, each measure of a text is held against the quartiles of its own language and source, from mergeable
quantile sketches (KLL): sketches are built per task, merged per (lang, source), merged again per language and over all. A
text fails a measure above ``q75 + REACH * (q75 - q25)``, the spread being at least the measure's floor (a group of which
most texts hold none of something would else have no spread at all). A group of fewer than SUPPORT texts uses its
language's sketch, a smaller language the sketch of all.

Measures: symbols per word, repeated words per word, repeated lines per line, characters per word, and the share of letters
in upper case. Texts that fail the base rules stay outside the sketches: they are dropped anyway. Null, empty and blank texts
have no words and fail the base. Null languages and sources are groups of their own; repeated rows count as often as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import words_of, written

SYMBOLS = "#*$%&|<>"
#: Measure: least spread. A fence thus never lies closer to the upper quartile than REACH times this.
MEASURES = {"symbol_rate": 0.03, "repeat_rate": 0.08, "dup_line_rate": 0.06, "word_length": 0.5, "upper_rate": 0.04}
REACH = 6.0
SUPPORT = 200
#: KLL accuracy: 200 is a rank error of about 1.3 %.
SKETCH = 200


def _repeated_words() -> Column:
    """Words in 3-word windows that occur twice or more.

    Window hashes, with the position in the low bits, are sorted as plain numbers; equal neighbours are repeats. Positions
    then count up to three words each, up to the next one.
    """
    packed = "sort_array(transform(sequence(1, n - 2), i -> shiftleft(xxhash64(element_at(w, i), element_at(w, i + 1), element_at(w, i + 2)), bits) | i))"
    return F.when(F.col("n") > 3, F.expr(packed)).otherwise(F.expr("CAST(array() AS array<bigint>)"))


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [c for c in docs.columns if c in ("doc_id", "lang", "source")]
    at = docs.select(*keep, text.alias("t"), words_of(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    at = at.withColumn("n", F.size("w"))
    at = at.withColumn("bits", F.length(F.bin(F.col("n"))))
    at = at.withColumn("packed", _repeated_words())
    repeated = "transform(filter(packed, (x, i) -> shiftright(x, bits) = shiftright(get(packed, i - 1), bits) OR shiftright(x, bits) = shiftright(get(packed, i + 1), bits)), x -> x & (shiftleft(1L, bits) - 1))"
    at = at.withColumn("places", F.sort_array(F.expr(repeated)))
    covered = "aggregate(places, CAST(named_struct('last', -3L, 'n', 0L) AS struct<last: bigint, n: bigint>), (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)), a -> a.n)"
    return at.select(
        *keep,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )


def measured(counted: DataFrame) -> DataFrame:
    """The counts with the base verdict and the measures."""
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    return counted.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbol_rate": per_word("n_symbols"),
            "repeat_rate": per_word("n_repeat_words"),
            "dup_line_rate": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "word_length": per_word("word_chars"),
            "upper_rate": F.col("n_upper") / F.greatest("word_chars", F.lit(1)),
        }
    )


def thresholds(rows: DataFrame, reach: float = REACH, support: int = SUPPORT) -> DataFrame:
    """lang, source and the fence of every measure there (``<measure>_max``), from texts that pass the base."""
    passed = rows.where("NOT base_failed")
    sketches = [F.kll_sketch_agg_double(m, F.lit(SKETCH)).alias(m) for m in MEASURES]
    groups = passed.groupBy("lang", "source").agg(F.count("*").alias("n"), *sketches)
    merged = [F.kll_merge_agg_double(m, F.lit(SKETCH)).alias(m) for m in MEASURES]
    by_lang = groups.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    overall = by_lang.agg(F.sum("n").alias("n"), *merged)

    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{tag}_{c}") for c in df.columns))

    # one row per group; a lang has few groups, and the overall sketch is a single row
    joined = groups.join(named(by_lang, "l"), F.col("lang").eqNullSafe(F.col("l_lang"))).join(F.broadcast(named(overall, "a")))

    def fence(m: str) -> Column:
        sketch = F.when(F.col("n") >= support, F.col(m)).when(F.col("l_n") >= support, F.col(f"l_{m}")).otherwise(F.col(f"a_{m}"))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        return (high + reach * F.greatest(high - low, F.lit(MEASURES[m]))).alias(f"{m}_max")

    return joined.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(fence(m) for m in MEASURES))


def judged(docs: DataFrame, reach: float = REACH, support: int = SUPPORT) -> DataFrame:
    """Counts, measures, fences, base_failed and kept for every row of ``docs`` (doc_id, text, lang, source)."""
    rows = measured(written(counts(docs), "counts"))
    fences = thresholds(rows, reach, support)
    joined = rows.join(fences, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    fine = ~F.col("base_failed")
    for m in MEASURES:
        fine &= F.coalesce(F.col(m) <= F.col(f"{m}_max"), F.lit(True))
    return joined.drop("g_lang", "g_source").withColumn("kept", fine)
