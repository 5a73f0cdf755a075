"""Line deduplication as an exact set-similarity join, with DataFrame operations only.

The tokens of a line are its distinct lower-cased words. Of two lines whose sets have a Jaccard similarity of PERCENT or more,
the later one (by doc_id, then line number) goes; a line goes if any earlier line matches it, whether or not that stays.

1. Token frequencies, added up in BUCKETS buckets of token hashes, give every token a rarity level: a table of BUCKETS bytes.
   The order of tokens (level, then hash) is the same in all lines, which is all that exactness asks of it.
2. Equal sets are grouped (partial aggregation first); the earliest line stands for its set.
3. Representatives send out the rarest tokens of their prefix: two sets that reach the threshold share one. Around a token, lines
   meet the earlier ones, under length, positional and parity filters, none of which can lose a match. Around a frequent token
   (level HOT or more), one that is near the first line of its size and place there meets only that. Of its candidates each
   line keeps the one nearest by parities.
4. Nearest candidates are verified on the whole sets. Lines whose nearest one falls short meet all their candidates that more
   bits of parity leave.

Defined cases: a line of 1 to SHORT - 1 words matches the lines of the same words in the same order; lines without words stay;
null texts have no line and come back null; lines of a null doc_id match nothing and stay; a text all of whose lines go comes
back empty; rows that share doc_id and text are one document and lose the same lines; texts of any length are split in their own
row; an empty table gives an empty result. All columns of the documents come back as they were, whatever their names, but for
the text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.functions.text import fence
from tallylog.llm.common import checked, written

#: Lines of fewer words are one token.
SHORT = 5
PERCENT = 75
#: The table of levels is a constant of the plan, and the driver keeps the text of every plan.
BUCKETS = 1 << 17
#: Levels per doubling of a frequency; a level must stay below 64.
STEPS = 2
#: Tokens of this level are frequent: over 1000 in their bucket.
HOT = 20


def _plain(text: str) -> Column:
    """A text in lower case whose words are parted by spaces and line feeds only."""
    lower = F.lower(text)
    other = reduce(or_, [F.contains(lower, F.lit(c)) for c in "\t\x0b\x0c\r"])
    return F.when(other, F.translate(lower, "\t\x0b\x0c\r", "    ")).otherwise(lower)


def _words(line: str) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, seq (line number, told apart by text) and line of all lines."""
    numbered = _texts(docs).select("doc_id", "of", F.posexplode(F.split(_plain("text"), "\n")).alias("no", "line"))
    return numbered.select("doc_id", F.shiftleft(F.col("no").cast("long"), 31).bitwiseOR(F.shiftrightunsigned("of", 33)).alias("seq"), "line")


def rarity_levels(docs: DataFrame) -> bytes:
    """A level per bucket of word hashes, from the frequencies in all texts: BUCKETS bytes, whatever the input."""
    words = _texts(docs).select(F.explode(F.split(F.replace(_plain("text"), F.lit("\n"), F.lit(" ")), " ")).alias("word")).where("word <> ''")
    counted = words.groupBy(F.xxhash64("word").bitwiseAND(BUCKETS - 1).alias("bucket")).count()
    rows = counted.select("bucket", F.least(F.lit(63), F.floor(STEPS * F.log2(F.col("count") + 1))).cast("int").alias("level")).toArrow()
    levels = np.zeros(BUCKETS, np.uint8)
    levels[rows["bucket"].to_numpy()] = rows["level"].to_numpy()
    return levels.tobytes()


def _sets(lines: DataFrame, levels: bytes) -> DataFrame:
    """``lines`` with w (words) and tokens for line: sorted numbers of 6 bits of level and 48 of hash, rarest first.

    Lines of fewer than SHORT words have null tokens. Fenced, so that what reads a column does not work it out again.
    """
    table = F.lit(levels)
    keys = [c for c in lines.columns if c != "line"]
    split = fence(lines.select(*keys, _words("line").alias("w")), "w")
    hashed = split.select(*keys, "w", F.when(F.size("w") >= SHORT, F.array_distinct(F.transform("w", lambda w: F.xxhash64(w)))).alias("h"))

    def token(h: Column) -> Column:
        level = F.ascii(F.substring(table, h.bitwiseAND(BUCKETS - 1).cast("int") + 1, 1).cast("string")).cast("long")
        return F.shiftleft(level, 48).bitwiseOR(F.shiftrightunsigned(h, 16))

    return fence(fence(hashed, "h").select(*keys, "w", F.sort_array(F.transform("h", token)).alias("tokens")), "tokens")


def _parity(bit: str) -> str:
    """64 bits: one is set if the ``bit`` of an odd number of tokens falls on it."""
    return f"aggregate(tokens, 0L, (a, x) -> a ^ shiftleft({bit}, CAST(x & 63L AS int)))"


def _in_brief(lines: DataFrame, levels: bytes) -> DataFrame:
    """doc_id, seq, n, of_set, prefix and parities (halves of 128 bits) of every line with words; n is 0 and the prefix empty for short ones."""
    sets = _sets(lines, levels).withColumn("n", F.coalesce(F.array_size("tokens"), F.lit(0))).where("size(w) > 0")
    # n - ceil(n * t) + 1 tokens: a set that shares none of them falls short of the threshold; 31 bits of each will do, the
    # last one tells the frequent ones
    prefix = f"IF(n > 2, slice(tokens, 1, n - ({PERCENT} * n + 99) div 100 + 1), array())"
    short = f"CAST((x & 4294967294L) - 2147483648L AS int) | IF(x >= {HOT << 48}L, 1, 0)"
    return sets.selectExpr(
        "doc_id",
        "seq",
        "n",
        "IF(n > 0, xxhash64(tokens), xxhash64(w)) AS of_set",
        f"transform(CAST({prefix} AS array<bigint>), x -> {short}) AS prefix",
        *(f"coalesce({_parity(bit)}, 0L) AS parity_{half}" for half, bit in enumerate(("1L", "shiftright(x, 6) & 1L"))),
    ).withColumn("parity_0", F.expr("parity_0 ^ parity_1"))


def _enough(shared: str, one: str, two: str) -> str:
    return f"100 * {shared} >= {PERCENT} * ({one} + {two} - {shared})"


def _sent(lines: DataFrame) -> DataFrame:
    """A row per token of the prefixes; n_pos is the size of the set above the place of the token."""
    sent = lines.selectExpr("doc_id", "seq", "n", "posexplode(prefix) AS (pos, token)", "parity_0", "parity_1")
    return sent.selectExpr("token", "doc_id", "seq", "shiftleft(CAST(n AS bigint), 32) | pos AS n_pos", "parity_0", "parity_1")


def _by_token(sent: DataFrame, only: str) -> DataFrame:
    """The rows around the tokens of a kind, dealt by token."""
    # nothing is null here; said of all columns, so that no use of the rows adds its own filter and one exchange serves all
    return sent.where(" AND ".join([only, *(f"{c} IS NOT NULL" for c in sent.columns)])).repartition("token")


def _near(a: str, b: str) -> tuple[str, str]:
    """Conditions on prefix tokens ``a`` and ``b`` of two lines that no pair fails at the first token it shares, and how many
    tokens one of both has alone at least."""
    # positional filter: behind the first shared token at places i and j at most min(n - i, m - j) tokens can be shared
    n, m, i, j = f"({a}n_pos >> 32)", f"({b}n_pos >> 32)", f"({a}n_pos & 4294967295L)", f"({b}n_pos & 4294967295L)"
    # every token that one set has alone flips one of 128 bits, and sets that reach the threshold have few of those
    apart = f"(bit_count({a}parity_0 ^ {b}parity_0) + bit_count({a}parity_1 ^ {b}parity_1))"
    return f"{_enough(f'least({n} - {i}, {m} - {j})', n, m)} AND {apart} <= {_alone(n, m)}", apart


def _earlier(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """doc_id, seq, to_doc, to_seq, apart of the lines that meet around a token of ``later`` and pass all filters."""
    near, apart = _near("a.", "b.")
    order = "(b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.seq < a.seq))"
    joined = later.alias("a").join(earlier.alias("b"), F.expr(f"a.token = b.token AND {order} AND {near}"))
    return joined.selectExpr("a.doc_id", "a.seq", "b.doc_id AS to_doc", "b.seq AS to_seq", f"{apart} AS apart")


def _all_met(sent: DataFrame) -> DataFrame:
    """What ``_earlier(sent, sent)`` gives: pairs of which the lines meet, the larger set (of equal ones the later line) first.

    The first token that both share is among the first 1 in 7 of the smaller set or thereabouts, since the larger one has at
    least as many; so only those are looked up. Not for frequent tokens.
    """
    near, apart = _near("a.", "b.")
    # as many tokens must be shared as by two sets of the smaller size
    total = 100 + PERCENT
    size = "shiftright(n_pos, 32)"
    looked = fence(sent, "n_pos").where(f"(n_pos & 4294967295L) <= {size} - ({2 * PERCENT} * {size} + {total - 1}) div {total}")
    later = "(b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.seq < a.seq))"
    order = f"(a.n_pos >> 32 > b.n_pos >> 32 OR (a.n_pos >> 32 = b.n_pos >> 32 AND {later}))"
    joined = sent.alias("a").join(looked.alias("b"), F.expr(f"a.token = b.token AND {order} AND {near}"))
    ends = {"doc_id": ("a.doc_id", "b.doc_id"), "seq": ("a.seq", "b.seq"), "to_doc": ("b.doc_id", "a.doc_id"), "to_seq": ("b.seq", "a.seq")}
    return joined.selectExpr(*(f"IF({later}, {a}, {b}) AS {c}" for c, (a, b) in ends.items()), f"{apart} AS apart")


def _candidates(sent: DataFrame) -> DataFrame:
    """doc_id, seq, to_doc, to_seq, apart, led: pairs of a line and an earlier one; led, if the line met only that around some token.

    Around a frequent token, a line that is near the first one of its size and place meets no other line there: a large group of
    similar lines makes a row per line, not per pair. Whether that line matches is verified later.
    """
    rare, frequent = _by_token(sent, "token & 1 = 0"), _by_token(sent, "token & 1 = 1")
    near, apart = _near("", "lead.")
    lead = frequent.selectExpr("*", "min(struct(doc_id, seq, n_pos, parity_0, parity_1)) OVER (PARTITION BY token, n_pos) AS lead")
    lead = lead.withColumn("led", F.expr(f"(lead.doc_id <> doc_id OR lead.seq <> seq) AND {near}"))
    by_lead = lead.where("led").selectExpr("doc_id", "seq", "lead.doc_id AS to_doc", "lead.seq AS to_seq", f"{apart} AS apart", "true AS led")
    met = _all_met(rare).unionByName(_earlier(lead.where("NOT led").drop("lead", "led"), frequent)).withColumn("led", F.lit(False))
    return by_lead.unionByName(met).groupBy("doc_id", "seq", "to_doc", "to_seq").agg(F.min("apart").alias("apart"), F.max("led").alias("led"))


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """doc_id, seq (line number, told apart by text) of every line to be removed from ``docs`` (doc_id, text)."""
    levels = rarity_levels(docs)
    brief = written(_in_brief(_lines(docs), levels), "lines")

    first = brief.groupBy("of_set", "n").agg(F.min(F.struct("doc_id", "seq", "prefix", "parity_0", "parity_1")).alias("head"), F.count("*").alias("times"))
    heads = written(first.select("of_set", "n", "times", "head.*"), "line-heads")
    # a join of two tables that grow with the input shuffles at every size
    heads_of = heads.where("times > 1").selectExpr("of_set", "n", "doc_id AS head_doc", "seq AS head_seq").hint("merge")
    same = brief.select("of_set", "n", "doc_id", "seq").join(heads_of, ["of_set", "n"]).where("head_doc <> doc_id OR head_seq <> seq")

    # one or two tokens match nothing but an equal set
    sent = _sent(heads.where("n > 2"))
    pairs = written(_candidates(sent), "line-candidates")
    to = F.min(F.struct("apart", "to_doc", "to_seq")).alias("to")
    nearest = pairs.groupBy("doc_id", "seq").agg(to, F.max("led").alias("led"), F.count("*").alias("times"))
    nearest = written(nearest.select("doc_id", "seq", "to.to_doc", "to.to_seq", "led", "times"), "line-nearest")
    found = written(_verified(docs, nearest.drop("led", "times")), "line-found")

    # lines whose nearest candidate fell short meet all others: those at hand, and those around tokens where they were led
    rest = nearest.where("led OR times > 1").join(found.hint("merge"), ["doc_id", "seq"], "left_anti")
    rest = written(rest, "line-rest")
    others = pairs.select("doc_id", "seq", "to_doc", "to_seq").join(checked(rest.select("doc_id", "seq")), ["doc_id", "seq"], "left_semi")
    led = written(_sent(heads.join(checked(rest.where("led").select("doc_id", "seq")), ["doc_id", "seq"], "left_semi")).where("token & 1 = 1"), "line-rest-sent")
    others = others.unionByName(_earlier(checked(led), sent.where("token & 1 = 1")).drop("apart"))
    tried = rest.select("doc_id", "seq", "to_doc", "to_seq").hint("merge")
    more = written(others.distinct().join(tried, ["doc_id", "seq", "to_doc", "to_seq"], "left_anti"), "line-pairs")
    return same.select("doc_id", "seq").unionByName(found).unionByName(_verified(docs, more, doubtful=True)).distinct()


def _alone(n: str, m: str) -> str:
    """How many tokens two sets of ``n`` and ``m`` that reach the threshold have alone at most, both together."""
    total = 100 + PERCENT
    return f"{n} + {m} - 2 * (({PERCENT} * ({n} + {m}) + {total - 1}) div {total})"


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` without those whose ``sets`` (doc_id, seq, tokens) are too far apart by 512 bits of parity; none that match go."""
    word = "aggregate(filter(tokens, x -> (shiftright(x, 6) & 7L) = k), 0L, (a, x) -> a ^ shiftleft(1L, CAST(x & 63L AS int)))"
    briefs = written(sets.selectExpr("doc_id", "seq", "size(tokens) AS n", f"transform(sequence(0, 7), k -> {word}) AS bits"), "line-parities")
    to = briefs.selectExpr("doc_id AS to_doc", "seq AS to_seq", "n AS to_n", "bits AS to_bits")
    apart = "aggregate(zip_with(bits, to_bits, (a, b) -> bit_count(a ^ b)), 0, (a, b) -> a + b)"
    near = pairs.join(briefs, ["doc_id", "seq"]).join(to, ["to_doc", "to_seq"]).where(f"{apart} <= {_alone('n', 'to_n')}")
    return written(near.select("doc_id", "seq", "to_doc", "to_seq"), "line-likely")


def _verified(docs: DataFrame, pairs: DataFrame, doubtful: bool = False) -> DataFrame:
    """The (doc_id, seq) of ``pairs`` whose partner (to_doc, to_seq) is similar enough, on the whole sets.

    Of ``doubtful`` pairs few match and a line has many, so that whole sets are sent for the likely ones only.
    """
    ends = pairs.select("doc_id", "seq").unionByName(pairs.select(F.col("to_doc").alias("doc_id"), F.col("to_seq").alias("seq")))
    want = written(ends.groupBy("doc_id").agg(F.collect_set("seq").alias("want")), "line-ends")
    some = _texts(docs).join(checked(want), "doc_id")
    # the numbers that ask for lines of this text, told apart by its hash; lines are taken by number
    own = F.filter("want", lambda q: q.bitwiseAND((1 << 31) - 1) == F.shiftrightunsigned("of", 33))
    split = fence(some.select("doc_id", own.alias("own"), F.split(_plain("text"), "\n").alias("lines")), "own", "lines")
    asked = F.transform("own", lambda q: F.struct(q.alias("seq"), F.get(F.col("lines"), F.shiftright(q, 31).cast("int")).alias("line")))
    words = fence(split.select("doc_id", F.inline(asked)).select("doc_id", "seq", _words("line").alias("w")), "w")
    # 48 bits tell words apart, as in the sets
    sets = words.select("doc_id", "seq", F.array_distinct(F.transform("w", lambda w: F.shiftrightunsigned(F.xxhash64(w), 16))).alias("tokens"))
    sets = written(sets, "line-tokens").dropDuplicates(["doc_id", "seq"])
    if doubtful:
        pairs = _likely(pairs, sets)
    both = pairs.join(sets, ["doc_id", "seq"]).join(sets.selectExpr("doc_id AS to_doc", "seq AS to_seq", "tokens AS to_tokens"), ["to_doc", "to_seq"])
    shared = both.withColumn("shared", F.size(F.array_intersect("tokens", "to_tokens")))
    return shared.where(_enough("shared", "size(tokens)", "size(to_tokens)")).select("doc_id", "seq").distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the later of similar lines taken out of ``text``; all columns and rows stay."""
    gone = written(duplicate_lines(docs.select("doc_id", "text")), "line-gone")
    lists = written(gone.groupBy("doc_id").agg(F.collect_list("seq").alias("seqs")), "line-lists")
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("row"))
    joined = rows.join(checked(lists.withColumnRenamed("doc_id", "of")), F.col("row.doc_id") == F.col("of"), "left")
    # line numbers that go from this text, told apart by its hash; the text is split once and lines are taken by number
    tail = F.shiftrightunsigned(F.xxhash64("row.text"), 33)
    own = F.transform(F.filter("seqs", lambda q: q.bitwiseAND((1 << 31) - 1) == tail), lambda q: F.shiftright(q, 31).cast("int"))
    marked = F.when(F.col("row.text").isNotNull(), own)
    split = fence(joined.select("row", marked.alias("gone"), F.when(F.size(marked) > 0, F.split("row.text", "\n")).alias("lines")), "gone", "lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    cleaned = F.when(F.col("lines").isNotNull(), kept).otherwise(F.col("row.text"))
    return split.select(*(cleaned.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in columns))
