"""Cutoffs come from all labels, however many there are."""

import pytest
from pyspark.sql import functions as F

from lexloom.llm import quality_rules

GOOD = " ".join(f"wor{i:02d}" for i in range(60))
BAD = " ".join(f"w###{i:02d}" for i in range(60))


@pytest.fixture(scope="module")
def many(spark):
    """30,000 labelled documents, of which 190 of a rare language just show its risk, and an unlabelled bad one of it (-1)."""
    docs = spark.range(-1, 30_000).withColumnRenamed("id", "doc_id").withColumn("lang", F.expr("if(doc_id < 190, 'rare', 'en')"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") < 0, BAD).otherwise(GOOD))
    return docs, spark.range(30_000).selectExpr("id as doc_id", "1 as quality")


def test_report_uses_all_labels(many):
    got = {r.doc_id: r.kept for r in quality_rules.quality_report(*many).where("doc_id < 190").collect()}
    assert not got.pop(-1) and len(got) == 190 and all(got.values())


def test_pipeline_stage_uses_all_labels(many):
    docs, labels = many
    got = {r.doc_id for r in quality_rules.keep_good(docs, labels).where("doc_id < 190").collect()}
    assert got == set(range(190))
