"""Keyed parquet tables: append, upsert, insert of what is absent, replacement of a parent's rows, and blobs by content.

A table is partitioned by a hash bucket of its key; how many buckets it has is stored with it, so choose a number that makes a
bucket some hundred megabytes (`create`); a bucket may hold several files. A change is written once beside the table, then
rewrites the buckets that it touches, by dynamic partition overwrite, and reads no others. Rows whose key is null are not stored:
a bucket that lost its last row holds one such row, which `table` leaves out. One writer at a time. While a change's files are
moved into place a reader may see some buckets old and some new; a job that fails in that moment leaves them so, and doing
the same change again mends it. Helper columns start with two underscores; tables that have columns so named are refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = "key_bucket"


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _keyed(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    if taken := [c for c in rows.columns if c.startswith("__") or c == BUCKET]:
        raise ValueError(f"columns of these names cannot be stored: {', '.join(taken)}")
    return rows.dropna(subset=key).withColumn(BUCKET, _bucket(key, buckets))


def buckets_of(spark: SparkSession, path: str, otherwise: int) -> int:
    """The number of buckets stored with a table; tables without have `otherwise`."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_buckets")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return int(spark.read.text(f"{path}/_buckets").first()[0]) if there else otherwise


class _Staged:
    """A change written once beside its table, so that all its uses see the same rows; gone afterwards."""

    def __init__(self, rows: DataFrame, path: str):
        self.spark, self.path, self.rows = rows.sparkSession, f"{path}/_staged/{uuid.uuid4().hex}", rows

    def __enter__(self) -> DataFrame:
        self.rows.write.parquet(self.path)
        return self.spark.read.schema(self.rows.schema).parquet(self.path)

    def __exit__(self, *_) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The rows of a keyed table, without its bucket column."""
    return spark.read.parquet(path).dropna(subset=key).drop(BUCKET)


def _written(rows: DataFrame, mode: str, path: str) -> None:
    # rebalancing keeps a bucket in one file while that is small, and splits it among tasks when it is not
    rows.hint("rebalance", BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def append(rows: DataFrame, path: str, key: list[str], buckets: int = 64) -> None:
    """Add all rows as they are; the key need not be unique."""
    _written(_keyed(rows, key, buckets_of(rows.sparkSession, path, buckets)), "append", path)


def _touched(spark: SparkSession, path: str, changed: DataFrame) -> DataFrame:
    """The stored rows in the buckets of changed; at most as many numbers as there are buckets come to the driver."""
    numbers = [r[0] for r in changed.select(BUCKET).distinct().collect()]
    return spark.read.parquet(path).where(F.col(BUCKET).isin(numbers))


def _rewrite(rows: DataFrame, changed: DataFrame, path: str) -> None:
    emptied = changed.select(BUCKET).distinct()  # a row of nulls for each touched bucket, so that an empty one is written too
    _written(rows.unionByName(emptied, allowMissingColumns=True), "overwrite", path)


def upsert(rows: DataFrame, path: str, key: list[str], updated: str, buckets: int = 64) -> None:
    """Insert rows, or put them in the place of the stored row of their key. The latest `updated` wins; at a tie a new row
    before the stored one, and of new ones the first by all columns' hash. Nulls in `updated` are oldest."""
    spark = rows.sparkSession
    with _Staged(_keyed(rows, key, buckets_of(spark, path, buckets)), path) as new:
        old = _touched(spark, path, new)
        both = old.dropna(subset=key).withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
        order = Window.partitionBy(BUCKET, *key).orderBy(F.desc_nulls_last(updated), F.desc("__new"), F.xxhash64(*new.columns))
        _rewrite(both.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth", "__new"), new, path)


def insert_absent(rows: DataFrame, path: str, key: list[str], buckets: int = 64) -> None:
    """Insert the rows whose key is not stored, one for each key (the first by all columns' hash)."""
    spark = rows.sparkSession
    with _Staged(_keyed(rows, key, buckets_of(spark, path, buckets)), path) as new:
        first = Window.partitionBy(*key).orderBy(F.xxhash64(*new.columns))
        absent = new.join(_touched(spark, path, new).select(BUCKET, *key), [BUCKET, *key], "left_anti")
        _written(absent.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth"), "append", path)


def replace_children(rows: DataFrame, parents: DataFrame, path: str, parent: list[str], buckets: int = 64) -> None:
    """Take away all stored rows of `parents` and put `rows` there; a parent without rows ends up with none. Rows of other
    parents than the given ones are left out. The table's key is `parent`."""
    spark = rows.sparkSession
    n = buckets_of(spark, path, buckets)
    with _Staged(_keyed(parents.select(*parent).distinct(), parent, n), path) as gone:
        new = _keyed(rows, parent, n).join(gone, [BUCKET, *parent], "left_semi")
        kept = _touched(spark, path, gone).dropna(subset=parent).join(gone, [BUCKET, *parent], "left_anti")
        _rewrite(kept.unionByName(new), gone, path)


def put_blobs(rows: DataFrame, path: str, content: str = "content", buckets: int = 64) -> DataFrame:
    """Store each distinct content once, under its SHA-256, compressed by zstd; the manifest has rows' other columns with
    sha256 and n_bytes. A null content has a null hash and is not stored."""
    data = F.col(content).cast("binary")
    named = rows.withColumn("sha256", F.sha2(data, 256)).withColumn("n_bytes", F.octet_length(data).cast("long"))
    blobs = named.select("sha256", "n_bytes", data.alias("content"))
    create(blobs, path, ["sha256"], buckets)
    insert_absent(blobs, path, ["sha256"], buckets)
    return named.drop(content)


def create(like: DataFrame, path: str, key: list[str], buckets: int = 64) -> None:
    """An empty table with the columns of `like` and so many buckets, where there is none."""
    spark = like.sparkSession
    _keyed(like.limit(0), key, 1).withColumn(BUCKET, F.lit(0)).unionByName(spark.createDataFrame([(0,)], f"{BUCKET} int"), allowMissingColumns=True).write.mode("ignore").partitionBy(BUCKET).parquet(path)
    spark.createDataFrame([(str(buckets_of(spark, path, buckets)),)], "n string").coalesce(1).write.mode("ignore").text(f"{path}/_buckets")
