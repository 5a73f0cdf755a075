"""From raw documents to packed sequences: the training-data operators in a row, each stage written before the next.

The stages, in order: documents that the quality classifier rejects go; later copies of similar lines go; one document of
each group of near duplicates stays; documents that hold a benchmark item go; what is left is packed. A stage decides per
doc_id (rows that share one go together) and sees all rows its predecessor kept. SQL cannot express the classifier, so
``ORACLE_SQL`` is None; ``tests/llm`` holds the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm.common import drop_documents, table, written
from tallylog.llm.crf import quality_scores
from tallylog.llm.decontaminate import contaminated
from tallylog.llm.linededup import dedup_lines
from tallylog.llm.neardup import near_duplicates
from tallylog.llm.packing import pack, token_pieces


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = quality_scores(docs, table(spark, sf_dir, "labels"))
    rejected = written(scores.where("predicted = 0").select("doc_id").distinct(), "rejected")
    return drop_documents(docs, rejected)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = written(near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "copies")
    return drop_documents(docs, copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = written(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return drop_documents(docs, leaks)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), release=True))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
