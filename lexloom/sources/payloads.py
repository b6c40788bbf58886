"""Gzipped JSON payloads in a blob store: corpora by book and analysis artifacts, verified against their manifest.

A blob that cannot be used is a row with an error, never a failed job; what it would have held comes from the table's own rows.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the only version of a corpus payload.
CORPUS_VERSION = "book-text-corpus-v1"
CORPUS = "schemaVersion string, bookId string, chapters array<struct<chapterId: string, orderIndex: int, title: string, rawText: string>>"


def encoded(json: Column) -> Column:
    """A JSON text as a gzipped blob; equal texts give equal bytes."""

    @F.pandas_udf("binary")
    def zipped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else gzip.compress(t.encode(), mtime=0))

    return zipped(json)


def _inflated(content: Column) -> Column:
    @F.pandas_udf("string")
    def text(blobs: pd.Series) -> pd.Series:
        def one(b):
            try:
                return None if b is None else gzip.decompress(b).decode()
            except (OSError, EOFError, zlib.error, UnicodeDecodeError):
                return None

        return blobs.map(one)

    return text(content)


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    """(storage_key, content): all files below a folder; the key is the path from there on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = F.regexp_replace(F.col("path"), r"^[a-z0-9+.-]+:/*", "/")
    return files.select(F.substring(inside, len("/" + folder.split(":", 1)[-1].strip("/")) + 2, 10_000).alias("storage_key"), "content")


def verified(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """manifest (storage_key, and if known size_bytes, sha256 and compression) with `text`, the blob's inflated text, and `error`:
    COMPRESSION, MISSING, SIZE, CHECKSUM or GZIP, the first that holds. Only blobs without one of the first four are inflated."""
    had = manifest.columns
    known = lambda c, kind: F.col(c) if c in had else F.lit(None).cast(kind)
    joined = manifest.join(stored.select("storage_key", F.col("content").alias("__content")), "storage_key", "left")
    wrong = F.when(F.lower(F.trim(F.coalesce(known("compression", "string"), F.lit("gzip")))) != "gzip", "COMPRESSION").when(F.col("__content").isNull(), "MISSING")
    wrong = wrong.when(F.octet_length("__content") != known("size_bytes", "long"), "SIZE").when(F.sha2("__content", 256) != F.lower(F.trim(known("sha256", "string"))), "CHECKSUM")
    checked = joined.withColumn("__wrong", wrong).withColumn("text", _inflated(F.when(F.col("__wrong").isNull(), F.col("__content"))))
    return checked.withColumn("error", F.coalesce("__wrong", F.when(F.col("text").isNull(), "GZIP"))).select(*had, "text", "error")


def corpora(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """(storage_key, book_id, chapters, error): the corpora of a manifest. Besides verified's errors JSON, VERSION and BOOK (no
    book's id). Chapters without an id or a positive place are left out; the others are in order."""
    read = verified(manifest, stored).withColumn("__p", F.from_json("text", CORPUS))
    p, version = F.col("__p"), F.trim(F.coalesce("__p.schemaVersion", F.lit("")))
    plain = F.col("text").rlike(r"^\s*\{")  # from_json gives a row of nulls for what is no object
    error = F.coalesce("error", F.when(p.isNull() | ~plain | F.try_parse_json("text").isNull(), "JSON").when((version != "") & (version != CORPUS_VERSION), "VERSION").when(F.trim(F.coalesce(p.bookId, F.lit(""))) == "", "BOOK"))
    usable = F.filter(F.coalesce(p.chapters, F.array().cast("array<struct<chapterId: string, orderIndex: int, title: string, rawText: string>>")), lambda c: (F.trim(F.coalesce(c.chapterId, F.lit(""))) != "") & (c.orderIndex > 0))
    shaped = F.transform(usable, lambda c: F.struct(c.orderIndex.alias("order_index"), F.trim(c.chapterId).alias("chapter_id"), F.trim(F.coalesce(c.title, F.lit(""))).alias("title"), F.coalesce(c.rawText, F.lit("")).alias("text")))
    out = read.withColumn("__e", error)
    return out.select("storage_key", F.when(F.col("__e").isNull(), F.trim(p.bookId)).alias("book_id"), F.when(F.col("__e").isNull(), F.array_sort(shaped)).alias("chapters"), F.col("__e").alias("error"))


def chapter_texts(chapters: DataFrame, read: DataFrame) -> DataFrame:
    """chapters (book_id, chapter_id, order_index, title, raw_text) with `text` and `origin`: the blob's text by the chapter's id,
    else by its place (the first there), else the table's own, else none (missing)."""
    held = read.where("error IS NULL").select("book_id", F.explode("chapters").alias("c")).select("book_id", "c.*")
    by_id = held.groupBy("book_id", "chapter_id").agg(F.max_by("text", "order_index").alias("__id"))
    by_place = held.groupBy("book_id", "order_index").agg(F.min_by("text", "chapter_id").alias("__place"))
    both = chapters.join(by_id, ["book_id", "chapter_id"], "left").join(by_place, ["book_id", "order_index"], "left")
    origin = F.when(F.col("__id").isNotNull(), "blob").when(F.col("__place").isNotNull(), "place").when(F.col("raw_text").isNotNull(), "table").otherwise("missing")
    return both.withColumn("origin", origin).withColumn("text", F.coalesce("__id", "__place", "raw_text")).select(*chapters.columns, "text", "origin")


def artifacts(rows: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """rows (storage_key, fields...) with `error`, and the fields that a row's payload names in the place of the row's own. Rows
    without a key keep theirs and have no error."""
    keyed, rest = rows.where("storage_key IS NOT NULL"), rows.where("storage_key IS NULL")
    read = verified(keyed, stored)
    error = F.coalesce("error", F.when(F.try_parse_json("text").isNull(), "JSON"))
    own = {f: F.coalesce(F.get_json_object(F.when(error.isNull(), F.col("text")), f"$.{f}").cast(dict(rows.dtypes)[f]), F.col(f)) for f in fields}
    return read.withColumns(own | {"error": error}).select(*rows.columns, "error").unionByName(rest.withColumn("error", F.lit(None).cast("string")))
