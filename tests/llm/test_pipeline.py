"""The pipeline's stages against brute force, each on what its predecessor kept, and on awkward rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallylog.llm.common import written
from tests.llm import helpers

SF_DIR = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    quality, lines, near, clean, packed = (stage for _, stage in corpus_pipeline.STAGES)

    before = {r.doc_id: r.text for r in docs.collect()}
    docs = written(quality(spark, docs, SF_DIR), "stage")
    after = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and after.items() <= before.items()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    good = [d for d in before if labels.get(d) == 1]
    assert sum(d in after for d in good) > 0.97 * len(good)
    assert not any(d in after for d in before if labels.get(d) == 0)

    docs = written(lines(spark, docs, SF_DIR), "stage")
    assert {r.doc_id: r.text for r in docs.collect()} == helpers.deduped_lines(list(after.items()))
    assert docs.columns == columns and docs.where("n_chars <> length(text)").count() == 0

    before = {r.doc_id: r.text for r in docs.collect()}
    docs = written(near(spark, docs, SF_DIR), "stage")
    group = helpers.near_duplicate_components(list(before.items()))
    assert {r.doc_id for r in docs.collect()} == {d for d in before if group[d] == d} and docs.columns == columns

    before = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    docs = written(clean(spark, docs, SF_DIR), "stage")
    leaks = {doc for doc, _ in helpers.contaminated_pairs(list(before.items()), items)}
    assert leaks and {r.doc_id for r in docs.collect()} == before.keys() - leaks and docs.columns == columns

    rows = packed(spark, docs, SF_DIR)
    assert {r.doc_id for r in rows.select("doc_id").collect()} == before.keys() - leaks
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows_pass_every_stage(spark, empty):
    rows = [] if empty else [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c d e f", "en", None, 11), (3, "one two three four five six\n" * 3, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("item_id", F.lit(2))
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), "stage")
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(docs.columns)
    assert docs.count() == (0 if empty else docs.count())
