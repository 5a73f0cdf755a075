"""URL filters: rules first, then a character language-model ratio for URLs that no rule fits.

Two variable-order Markov models over characters, one of the URLs that the rules allow and one of those they block, give every
character of a URL a probability from its longest seen context, smoothed down to shorter ones (Witten-Bell). The score is the
difference of log-likelihoods per character. The threshold is calibrated on a fifth of the ruled URLs, by hash, scored under
models of the other four fifths, for the best balanced accuracy. A URL at or above it is allowed.

The models that judge count all ruled URLs, the fifth included. Everything is an aggregation or a join on grams of up to ORDER + 1 characters: probabilities
are worked out once per distinct gram of the URLs to be scored, then summed per URL; no model is collected or broadcast.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is scored on its own text; an
empty URL, or models without both kinds of URL, scores 0; without both kinds in the fifth and in the rest there is nothing to
calibrate on, and the threshold is 0, which allows a score of 0. Repeated pages are judged each; a page_id that occurs twice
keeps both rows. A URL of any length is cut into grams whole, in its own row; an empty table gives an empty result; columns
other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import written

#: Fixed values: (verdict, host/path prefix).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
ORDER = 4
#: Characters the models can see, for the uniform base.
ALPHABET = 128
CALIBRATION = 5
#: Scores are compared in steps of this size when the threshold is chosen, so the table of them stays small.
STEP = 0.01


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case and path of a URL, both empty without ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, lowered).otherwise(""), F.when(known, path).otherwise("")


def with_rules(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, and rule and ruled (verdict) of the longest rule that fits."""
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = verdict = None
    for what, pattern in sorted(rules, key=lambda r: -len(r[1])):
        domain, _, prefix = pattern.partition("/")
        fits = ((F.col("host") == domain) | F.endswith("host", F.lit(f".{domain}"))) & F.startswith("path", F.lit(f"/{prefix}"))
        rule = F.when(fits, pattern) if rule is None else rule.when(fits, pattern)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return out.withColumns({"rule": rule, "ruled": verdict}) if rules else out.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and gram: each character of a URL behind its ORDER predecessors (starts are padded with ^)."""
    padded = F.concat(F.lit("^" * ORDER), "text", F.lit("$"))
    return urls.withColumn("padded", padded).select(*keep, F.explode(F.expr(f"transform(sequence(1, length(padded) - {ORDER}), i -> substring(padded, i, {ORDER + 1}))")).alias("gram"))


def gram_scores(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram and llr: log P(character | context) under the allowed model less that under the blocked one.

    ``known`` has gram, ruled and n (occurrences); ``wanted`` the distinct grams to score.
    """
    out = wanted.withColumns({"p_allow": F.lit(1.0 / ALPHABET), "p_block": F.lit(1.0 / ALPHABET)})
    for order in range(ORDER + 1):
        # the last order + 1 characters: a context of ``order`` characters and the one behind it
        tails = known.groupBy(F.substring("gram", ORDER + 1 - order, order + 1).alias("tail")).agg(*(F.sum(F.when(F.col("ruled") == v, F.col("n")).otherwise(0)).alias(f"n_{v}") for v in ("allow", "block")))
        contexts = tails.groupBy(F.substring("tail", 1, order).alias("context")).agg(*(f(v).alias(f"{k}_{v}") for v in ("allow", "block") for k, f in (("c", lambda v: F.sum(f"n_{v}")), ("t", lambda v: F.sum((F.col(f"n_{v}") > 0).cast("long"))))))
        out = out.withColumn("tail", F.substring("gram", ORDER + 1 - order, order + 1)).withColumn("context", F.substring("tail", 1, order))
        if order == 0:  # one context, and as many tails as there are characters
            contexts, tails = F.broadcast(contexts), F.broadcast(tails)
        out = out.join(contexts, "context", "left").join(tails, "tail", "left")
        for v in ("allow", "block"):
            seen = F.coalesce(F.col(f"c_{v}"), F.lit(0))
            kinds = F.coalesce(F.col(f"t_{v}"), F.lit(0))
            mixed = (F.coalesce(F.col(f"n_{v}"), F.lit(0)) + kinds * F.col(f"p_{v}")) / F.greatest(seen + kinds, F.lit(1))
            out = out.withColumn(f"p_{v}", F.when(seen > 0, mixed).otherwise(F.col(f"p_{v}")))
        out = out.select("gram", "p_allow", "p_block")
    return out.select("gram", (F.log("p_allow") - F.log("p_block")).alias("llr"))


def scored(urls: DataFrame, known: DataFrame) -> DataFrame:
    """text and score for every distinct text of ``urls``, under models of ``known`` (gram, ruled, n)."""
    texts = urls.select("text").distinct()
    grams = _grams(texts, "text")
    llr = written(gram_scores(known, grams.select("gram").distinct()), "gram-scores")
    return grams.join(llr, "gram").groupBy("text").agg(F.avg("llr").alias("score"))


def calibrated(scores: DataFrame) -> float:
    """The threshold of best balanced accuracy on ``scores`` (ruled, score); 0 without both kinds."""
    table = scores.where("score IS NOT NULL").groupBy(F.round(F.col("score") / STEP).alias("at")).agg(*(F.sum((F.col("ruled") == v).cast("long")).alias(v) for v in ("allow", "block"))).orderBy("at").collect()
    allow, block = sum(r.allow for r in table), sum(r.block for r in table)
    if not allow or not block:
        return 0.0
    best, at, below_allow, below_block = -1.0, 0.0, 0, 0
    previous = None
    for row in table:
        value = (allow - below_allow) / allow + below_block / block
        if value > best + 1e-12:
            best, at = value, (row["at"] if previous is None else (row["at"] + previous) / 2) * STEP
        below_allow, below_block, previous = below_allow + row.allow, below_block + row.block, row["at"]
    return at


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides) for every page."""
    ruled = written(with_rules(pages, rules).withColumn("text", F.coalesce("url", F.lit(""))), "urls")
    known = ruled.where("ruled IS NOT NULL")
    known = known.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0)
    # counted apart in the fold, so that one table serves both pairs of models
    grams = written(_grams(known, "ruled", "fold").groupBy("gram", "ruled", "fold").agg(F.count("*").alias("n")), "grams")
    kinds = {(row["ruled"], row["fold"]) for row in known.select("ruled", "fold").distinct().collect()}
    threshold = 0.0
    if len(kinds) == 4:
        unseen = known.where("fold")
        threshold = calibrated(unseen.join(scored(unseen, grams.where("NOT fold")), "text"))
    both = len({verdict for verdict, _ in kinds}) == 2
    rest = ruled.where("ruled IS NULL")
    scores = scored(rest, grams) if both else rest.select("text").distinct().withColumn("score", F.lit(0.0))
    out = ruled.join(written(scores, "url-scores"), "text", "left")
    lm = F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", lm).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score"))
