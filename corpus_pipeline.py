"""From documents to packed training sequences: five stages, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import pattern_packing, pii, quality_rules, simhash_dedup, source_mixing
from lexloom.llm.common import checkpointed, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Null and empty texts fail the base rule; repeated rows are judged alike; columns
    named __quality_* are overwritten; an empty table stays empty, as in all stages."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, that of the smallest doc_id. Texts without words are one group; of
    rows that repeat a doc_id one stays; rows without doc_id all stay."""
    return simhash_dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with found personal data replaced by its kind. A null text stays null; repeated rows are redacted alike;
    columns named __pii_* are overwritten."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture of sources takes them. Null languages and sources count as empty names; rows without
    doc_id are left out; rows that repeat one are taken alike."""
    return source_mixing.mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 4096 tokens. A null text is an empty one, its end token
    alone; repeated rows are packed one by one."""
    return pattern_packing.packed_report(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]
#: SQL has neither seeded 64-bit hashes nor the fitted packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the checkpoint folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
