"""Event streams: counters, rate limits, idempotent intake and sessions with an explicit end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str) -> DataFrame:
    """Events from parquet files below a folder, as they arrive; ts as an instant in UTC."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def series(events: DataFrame, bucket: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Turns and value by time bucket and type; rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", bucket), "event_type").agg(F.count("*").alias("turns"), F.sum("value").alias("value"))


def allowed(events: DataFrame, limit: int = 2, bucket: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests by key and fixed window, and how many of them the limit admits."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", bucket), "user_id").agg(F.count("*").alias("n"))
    return counted.withColumn("allowed", F.least("n", F.lit(limit)))


def idempotent(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, begin: str = "signup", end: str = "purchase") -> DataFrame:
    """(user_id, n, total) whenever a user's accumulation ends; it begins with `begin` and gathers values until `end`."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, n, total = state.get if state.exists else (False, 0, 0.0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, value in zip(rows["event_type"], rows["value"], strict=True):
            if kind == begin:
                active, n, total = True, 0, 0.0
            elif active and kind == end:
                out.append((key[0], n, total))
                active = False
            elif active:
                n, total = n + 1, total + value
        state.update((active, n, total))
        yield pd.DataFrame(out, columns=["user_id", "n", "total"])

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "active boolean, n long, total double", "append", GroupStateTimeout.NoTimeout)
