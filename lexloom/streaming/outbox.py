"""An outbox of tasks as a keyed table: requests from a stream, claims with a lease, retries with growing delays, dead letters.

Each micro-batch is one turn: new requests go in once, due tasks are claimed, a dispatcher says what became of them, and their rows
are written back. A turn's changes are kept in a journal under its batch id before the table is touched. A batch that Spark
plays again after a failure finds its journal and only repeats the (idempotent) upsert, so it neither claims nor counts twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.sources import sinks

#: Tasks of a claim, attempts before a dead letter, the lease, and the bounds of the delay in milliseconds.
BATCH, ATTEMPTS, LEASE_MS, BASE_MS, MOST_MS, LEAST_MS = 16, 8, 600_000, 5_000, 900_000, 1_000
#: Parts of errors that no retry mends.
HARD = ("book not found", "unsupported stored book format")
TASK = "id long, kind string, payload string, created_at timestamp, available_at timestamp, processed_at timestamp, attempts int, state string, error string, changed_in long"
KEY = ["id"]


def hard(error: Column) -> Column:
    """Whether an error is one that no retry mends."""
    e = F.lower(error)
    out = e.contains("invalid") & e.contains("payload")
    for part in HARD:
        out = out | e.contains(part)
    return out


def delay_ms(attempt: Column, jitter: Column | float = 0.5) -> Column:
    """Milliseconds before the next attempt: doubled each time, at most a quarter of an hour, times 0.5 to 1.5."""
    return F.greatest(F.lit(float(LEAST_MS)), F.least(F.lit(float(MOST_MS)), BASE_MS * F.pow(F.lit(2.0), attempt - 1)) * (0.5 + jitter))


def later(at: Column, ms: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + (ms * 1000).cast("long"))


def due(tasks: DataFrame, now: Column, kinds: tuple[str, ...], most: int = BATCH) -> DataFrame:
    """The tasks to claim: open, available, of the given kinds, the longest waiting first; a top-n, no full sort."""
    return tasks.where(F.col("processed_at").isNull() & (F.col("available_at") <= now) & F.col("kind").isin(*kinds)).orderBy("available_at", "created_at", "id").limit(most)


def claimed(tasks: DataFrame, now: Column) -> DataFrame:
    """Claimed tasks are not available to others until the lease ends."""
    return tasks.withColumn("available_at", later(now, F.lit(LEASE_MS))).withColumn("state", F.lit("claimed"))


def settled(tried: DataFrame, now: Column, jitter: Column | float = 0.5) -> DataFrame:
    """What became of dispatched tasks (with column outcome: the error, null for none): processed, to be retried later, or dead
    because the error is hard or the attempts are spent."""
    attempt = F.when(F.col("outcome").isNull(), F.col("attempts")).otherwise(F.col("attempts") + 1)
    dead = F.col("outcome").isNotNull() & (hard(F.col("outcome")) | (F.col("attempts") + 1 >= ATTEMPTS))
    done = F.col("outcome").isNull()
    marked = tried.withColumns({"__dead": dead, "__attempt": attempt})
    return marked.withColumns({
        "processed_at": F.when(done | F.col("__dead"), now), "available_at": F.when(done, now).when(F.col("__dead"), F.col("available_at")).otherwise(later(now, delay_ms(F.col("__attempt"), jitter))),
        "attempts": F.col("__attempt").cast("int"), "state": F.when(done, "processed").when(F.col("__dead"), "dead_letter").otherwise("retry"), "error": F.substring("outcome", 1, 2000),
    }).drop("outcome", "__dead", "__attempt")


def turn(requests: DataFrame, batch_id: int, path: str, clock: Callable[[int], Column], dispatch: Callable[[DataFrame], DataFrame], kinds: tuple[str, ...], most: int = BATCH) -> None:
    """One micro-batch over the tables below `path`: tasks and journal. Requests have id, kind, payload and created_at; `clock`
    gives the batch's time, and `dispatch` adds the column outcome to claimed tasks."""
    spark, now = requests.sparkSession, clock(batch_id)
    tasks, journal = f"{path}/tasks", f"{path}/journal/batch={batch_id}"
    sinks.create(spark.createDataFrame([], TASK), tasks, KEY)
    none = lambda kind: F.lit(None).cast(kind)
    fresh = requests.select("id", "kind", "payload", "created_at", F.col("created_at").alias("available_at"), none("timestamp").alias("processed_at"), F.lit(0).alias("attempts"), F.lit("new").alias("state"), none("string").alias("error"), F.lit(batch_id).cast("long").alias("changed_in"))
    if not _there(spark, f"{journal}/_SUCCESS"):
        sinks.insert_absent(fresh, tasks, KEY)
        taken = claimed(due(sinks.table(spark, tasks, KEY), now, kinds, most), now)
        made = settled(dispatch(taken), now).withColumn("changed_in", F.lit(batch_id).cast("long"))
        made.write.mode("overwrite").parquet(journal)
    sinks.upsert(spark.read.schema(TASK).parquet(journal), tasks, KEY, "changed_in")


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def outbox(requests: DataFrame, path: str, checkpoint: str, clock: Callable[[int], Column], dispatch: Callable[[DataFrame], DataFrame], kinds: tuple[str, ...], most: int = BATCH) -> StreamingQuery:
    """Runs turns over a stream of requests until what is there has been read."""
    writer = requests.writeStream.foreachBatch(lambda batch, i: turn(batch, i, path, clock, dispatch, kinds, most))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
