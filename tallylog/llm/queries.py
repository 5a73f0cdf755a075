"""The training-data operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tallylog.llm.chat import perspectives
from tallylog.llm.common import table
from tallylog.llm.crf import held_out, quality_scores
from tallylog.llm.decontaminate import contaminated
from tallylog.llm.linededup import dedup_lines
from tallylog.llm.neardup import near_duplicates
from tallylog.llm.packing import pack, token_pieces
from tallylog.llm.repair import repair
from tallylog.llm.rules import judged
from tallylog.llm.spelling import changed, corpus_words, variants
from tallylog.llm.suffix import without_repeats
from tallylog.llm.tokenfile import token_ids
from tallylog.llm.urls import judged as judged_urls
from tallylog.llm.wrapper import main_text

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents"), WORD_BPE))


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    cleaned = dedup_lines(docs)
    return cleaned.select("doc_id", "text", "n_lines", F.length("text").cast("long").alias("n_chars_kept"))


def op7_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = judged(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(table(spark, sf_dir, "pages"))


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = without_repeats(docs, keep_first=False)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(corpus_words(table(spark, sf_dir, "documents"), changed))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults planted by the crc32 of ``conv_id:turn``: dropped, emptied, without end marks, repeated, or said by user."""
    case = "crc32(encode(concat(coalesce(CAST(conv_id AS string), ' '), ':', coalesce(CAST(turn AS string), ' ')), 'UTF-8')) % 20"
    rows = turns.selectExpr("conv_id", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text", f"{case} AS fault")
    return rows.selectExpr(
        "conv_id",
        "turn",
        "IF(fault = 4, 'user', role) AS role",
        "CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text",
        "explode(array_repeat(0, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy",
    ).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repair(damaged(turns)).drop("path", "n_turns")
    all_ids = turns.select(F.col("conv_id").alias("id")).distinct()
    whole = all_ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return whole.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_best_fit": op1_pack_best_fit,
    "op2_chat_perspectives": op2_chat_perspectives,
    "op3_simhash_decontamination": op3_simhash_decontamination,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_token_id_files": op5_token_id_files,
    "op6_line_dedup": op6_line_dedup,
    "op7_crf_quality": op7_crf_quality,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_language_models": op9_url_language_models,
    "op10_wrapper_induction": op10_wrapper_induction,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op2_chat_perspectives": """
WITH said AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS role, replace(coalesce(text, ''), '<|', '<| ') AS said
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'
), seats AS (
  SELECT s.*, p.speaker,
    CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>'
         ELSE '<|user|>' || replace(role, '<|', '<| ') || ': ' END AS header
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, header || said || '<|end|>' || chr(10) AS segment,
    row_number() OVER w - 1 AS position,
    CAST(sum(length(header) + length(said) + 8) OVER w AS BIGINT) AS after
  FROM seats
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, said ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, speaker, position, turn, role, segment, role = speaker AS train, after - length(segment) AS start,
  CASE WHEN role = speaker THEN after - length(segment) + length(header) ELSE after END AS mask_start, after AS mask_end
FROM placed
""",
    "op4_minhash_near_dedup": """
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM texts
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), least_of AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sets s JOIN least_of m ON s.doc_id = m.doc_id
""",
    "op11_suffix_array_dedup": """
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT rid, pos, md5(substr(h, 2 * pos + 1, 800)) AS digest
  FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 399)) AS pos FROM texts)
), repeated AS (
  SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY digest) AS n FROM strings) WHERE n > 1
), ends AS (
  SELECT rid, pos, pos + 400 AS after, lag(pos + 400) OVER (PARTITION BY rid ORDER BY pos) AS before FROM repeated
), runs AS (
  SELECT rid, pos, after, count(*) FILTER (before IS NULL OR before < pos) OVER (PARTITION BY rid ORDER BY pos) AS run FROM ends
), spans AS (
  SELECT rid, run, min(pos) AS start, max(after) AS stop FROM runs GROUP BY rid, run
), kept AS (
  SELECT rid, start, stop, coalesce(lag(stop) OVER w, 0) AS since, lead(start) OVER w AS next FROM spans WINDOW w AS (PARTITION BY rid ORDER BY start)
), cut AS (
  SELECT k.rid, CAST(sum(stop - start) AS BIGINT) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * since + 1, 2 * (start - since)), '' ORDER BY start)
      || max(CASE WHEN next IS NULL THEN substr(h, 2 * stop + 1) ELSE '' END) AS h
  FROM kept k JOIN texts t ON k.rid = t.rid GROUP BY k.rid
)
SELECT t.doc_id, length(t.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(c.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN cut c ON t.rid = c.rid
""",
    "op12_spelling_variants": """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
  GROUP BY ALL
), bytes AS (
  SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs
), hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, length(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT))),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS code
  FROM bytes, crc_table
), words AS (
  SELECT CASE WHEN code % 97 = 0 THEN left(run, (code % length(run))::INT) || substr(run, (code % length(run))::INT + 2) ELSE run END AS word,
    CAST(sum(times) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(times) >= 3
), cut AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, n, count(*) AS n_near, min({'less': -other_n, 'other': other}) AS usual FROM pairs GROUP BY word, n
), forms AS (
  SELECT word, n_near, CASE WHEN -usual.less >= 2 * n THEN usual.other END AS form, CASE WHEN -usual.less >= 2 * n THEN -usual.less END AS form_n
  FROM best
), ways(word, root, steps) AS (
  SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
  UNION ALL
  SELECT w.word, f.form, steps + 1 FROM ways w JOIN forms f ON w.root = f.word WHERE f.form IS NOT NULL
), led AS (
  SELECT word, max_by(root, steps) AS root FROM ways GROUP BY word
)
SELECT w.word, f.form, coalesce(l.root, w.word) AS root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN forms f ON w.word = f.word LEFT JOIN led l ON w.word = l.word
""",
}
