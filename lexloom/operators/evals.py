"""Retrieval quality: recall, reciprocal rank, keyword coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import half_up


def recall(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, recall_5, recall_10, mrr) of (query_id, ref, rank) against (query_id, ref)."""
    n = expected.groupBy("query_id").agg(F.count("*").alias("expected"))
    return recall_of(ranked.join(expected.withColumn("hit", F.lit(True)), ["query_id", "ref"], "left"), n)


def recall_of(marked: DataFrame, expected: DataFrame) -> DataFrame:
    """recall of (query_id, ref, rank, hit) where each query's number of expected refs is known: (query_id, expected)."""
    found = marked.join(expected, "query_id")
    share = lambda k: half_up(F.count(F.when(F.col("hit") & (F.col("rank") <= k), 1)) / F.first("expected"), 6)
    first = half_up(1 / F.min(F.when(F.col("hit"), F.col("rank"))), 6)
    return found.groupBy("query_id").agg(share(5).alias("recall_5"), share(10).alias("recall_10"), F.coalesce(first, F.lit(0.0)).alias("mrr"))


def keyword_coverage(answers: DataFrame, keywords: list[str]) -> DataFrame:
    """answers with the share of the keywords that the lower-cased text contains."""
    has: list[Column] = [F.when(F.contains(F.lower("text"), F.lit(k.lower())), 1).otherwise(0) for k in keywords]
    return answers.withColumn("coverage", sum(has, F.lit(0)) / float(len(keywords)))
