"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only where that is unset and all runs on one machine (tests) a new
    one is made; elsewhere other executors could not read it, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lexloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def sql_text(s: str) -> str:
    """A SQL string literal of s; escapes work as in the default parser settings."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the checkpoint folder, read again: like a checkpoint, but columnar and compressed."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
