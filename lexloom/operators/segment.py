"""Documents to paragraphs, chunks, scenes and overlapping fragments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom import config


def paragraphs(docs: DataFrame, split: str = "\n+", keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """One row for each non-empty part of a text, numbered from 1. The explosion is an outer one: from an inner one Spark infers
    a filter on the parts' number, for which it would split every text twice."""
    if split == "\n+":  # lines, each from its first to its last character that is no white space
        parts = F.regexp_extract_all("text", F.lit(r"\S(?:[^\n]*\S)?"), F.lit(0))
    else:
        parts = F.filter(F.transform(F.split("text", split), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return docs.select(*keep, "doc_id", F.posexplode_outer(parts).alias("pos", "text")).where("pos IS NOT NULL").select(*keep, "doc_id", (F.col("pos") + 1).alias("paragraph_index"), "text")


def sizes(paras: DataFrame) -> DataFrame:
    return paras.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))


def chunks(lengths: DataFrame, size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP) -> DataFrame:
    """Windows of `size` paragraphs by strides of size - overlap, until one reaches the last paragraph. (doc_id, n) in."""
    step = size - overlap
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step)), lambda s: (s == 0) | (s - step + size < F.col("n")))
    return lengths.where("n > 0").select("doc_id", "n", F.posexplode(starts).alias("chunk_index", "s")).select(
        "doc_id", "chunk_index", (F.col("s") + 1).alias("paragraph_start"), F.least(F.col("s") + size, F.col("n")).alias("paragraph_end")
    )


def scenes(lengths: DataFrame, width: int = config.SCENE_WIDTH) -> DataFrame:
    starts = F.posexplode(F.sequence(F.lit(1), F.col("n"), F.lit(width))).alias("i", "paragraph_start")
    return lengths.where("n > 0").select("doc_id", "n", starts).select(
        "doc_id", (F.col("i") + 1).alias("scene_index"), "paragraph_start", F.least(F.col("paragraph_start") + width - 1, F.col("n")).alias("paragraph_end")
    )


def windows_in(bounds: DataFrame, size: int, overlap: int) -> DataFrame:
    """Overlapping windows inside intervals (paragraph_start, paragraph_end): every step, and one that ends with the interval."""
    last = F.greatest(F.col("paragraph_start"), F.col("paragraph_end") - size + 1)
    starts = F.array_union(F.filter(F.sequence(F.col("paragraph_start"), F.col("paragraph_end"), F.lit(size - overlap)), lambda s: s <= last), F.array(last))
    kept = [c for c in bounds.columns if c not in ("paragraph_start", "paragraph_end")]
    return bounds.withColumn("s", F.explode(starts)).select(*kept, F.col("s").alias("window_start"), F.least(F.col("s") + size - 1, F.col("paragraph_end")).alias("window_end"))


def fragments(paras: DataFrame, cap_bytes: int = config.MEDIUM_BYTES) -> DataFrame:
    """Small and medium windows over whole documents with their text; a medium one is cut from its end to the byte cap."""
    whole = sizes(paras).select("doc_id", F.lit(1).alias("paragraph_start"), F.col("n").alias("paragraph_end"))
    kinds = [windows_in(whole, *shape).withColumn("fragment_type", F.lit(kind)) for kind, shape in (("small", config.FRAGMENT_SMALL), ("medium", config.FRAGMENT_MEDIUM))]
    members = kinds[0].unionByName(kinds[1]).withColumn("paragraph_index", F.explode(F.sequence("window_start", "window_end")))
    joined = members.join(paras.select("doc_id", "paragraph_index", "text"), ["doc_id", "paragraph_index"])
    upto = Window.partitionBy("doc_id", "fragment_type", "window_start").orderBy("paragraph_index")
    sized = joined.withColumn("bytes", F.sum(F.octet_length("text") + 2).over(upto) - 2)
    fits = sized.where((F.col("fragment_type") == "small") | (F.col("bytes") <= cap_bytes) | (F.col("paragraph_index") == F.col("window_start")))
    return fits.groupBy("doc_id", "fragment_type", "window_start").agg(
        F.max("paragraph_index").alias("window_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", "text"))), lambda x: x.text), "\n\n").alias("text"),
    )


def first_scene(paras: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each paragraph's first scene by order, null outside all: an interval join by explosion, so it is an equi join."""
    inside = bounds.select("doc_id", "scene_index", F.explode(F.sequence("paragraph_start", "paragraph_end")).alias("paragraph_index"))
    return paras.join(inside.groupBy("doc_id", "paragraph_index").agg(F.min("scene_index").alias("scene_index")), ["doc_id", "paragraph_index"], "left")


def primary_scenes(windows: DataFrame, bounds: DataFrame) -> DataFrame:
    """For each window all scenes it overlaps, the most overlapping first (ties: the earlier scene)."""
    w, b = windows.alias("w"), bounds.alias("b")
    on = (F.col("w.doc_id") == F.col("b.doc_id")) & (F.col("b.paragraph_start") <= F.col("w.window_end")) & (F.col("b.paragraph_end") >= F.col("w.window_start"))
    overlap = F.least("w.window_end", "b.paragraph_end") - F.greatest("w.window_start", "b.paragraph_start") + 1
    found = w.join(b, on).select("w.doc_id", "w.window_start", "w.window_end", (-overlap).alias("o"), F.col("b.scene_index").alias("scene"))
    order = found.groupBy("doc_id", "window_start", "window_end").agg(F.array_sort(F.collect_list(F.struct("o", "scene"))).alias("s"))
    return order.select("doc_id", "window_start", "window_end", F.col("s")[0].scene.alias("primary_scene"), F.array_join(F.transform("s", lambda x: x.scene.cast("string")), ",").alias("scene_ids"))


def gaps(bounds: DataFrame) -> DataFrame:
    """Consecutive intervals that do not follow on each other: by how much (negative: overlap)."""
    before = F.lag("paragraph_end").over(Window.partitionBy("doc_id").orderBy("paragraph_start", "paragraph_end"))
    return bounds.withColumn("gap", F.col("paragraph_start") - before - 1).where("gap <> 0").select("doc_id", "paragraph_start", "paragraph_end", "gap")


def repaired(bounds: DataFrame, lengths: DataFrame) -> DataFrame:
    """Intervals made to follow on each other and to cover the whole document: overlaps are trimmed from the start, swallowed
    intervals go, gaps are given to the interval before, the first and last are stretched to the bounds."""
    order = Window.partitionBy("doc_id").orderBy("paragraph_start", "paragraph_end")
    seen = bounds.withColumn("reach", F.coalesce(F.max("paragraph_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = seen.where("paragraph_end > reach").withColumn("s", F.greatest("paragraph_start", F.col("reach") + 1))
    by_start = Window.partitionBy("doc_id").orderBy("s")
    moved = kept.withColumn("i", F.row_number().over(by_start)).withColumn("after", F.lead("s").over(by_start))
    return moved.join(lengths, "doc_id").select("doc_id", F.col("i").alias("scene_index"), F.when(F.col("i") == 1, 1).otherwise(F.col("s")).alias("paragraph_start"), F.coalesce(F.col("after") - 1, F.col("n")).alias("paragraph_end"))


def packed_segments(paras: DataFrame, budget: int = config.SEGMENT_TOKENS, overhead: int = 0) -> DataFrame:
    """Contiguous segments of paragraphs that fit a token budget, greedily; a document is one group and paragraphs longer
    than the budget stand alone. The sum restarts at each segment, which no window frame expresses."""
    cost = F.ceil((F.length(F.col("paragraph_index").cast("string")) + 16 + F.length("text")) / config.CHARS_PER_TOKEN)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group, out, start, used = group.sort_values("paragraph_index"), [], None, overhead
        for i, c in zip(group["paragraph_index"], group["cost"], strict=True):
            if start is not None and used + c > budget:
                out.append((group["doc_id"].iloc[0], start, i - 1))
                start, used = None, overhead
            start, used = (i if start is None else start), used + c
        out.append((group["doc_id"].iloc[0], start, int(group["paragraph_index"].iloc[-1])))
        return pd.DataFrame(out, columns=["doc_id", "paragraph_start", "paragraph_end"])

    return paras.select("doc_id", "paragraph_index", cost.alias("cost")).groupBy("doc_id").applyInPandas(fold, "doc_id long, paragraph_start int, paragraph_end int")


def repaired_within(units: DataFrame, key: list[str]) -> DataFrame:
    """units (key..., lo, hi, paragraph_start, paragraph_end, others...) of segments lo to hi, repaired as in `repaired`: the first
    starts at lo, the last ends at hi, gaps go to the unit before, overlaps are trimmed from the start, swallowed units go. Adds
    scene_index. Ends must not be over hi."""
    order = Window.partitionBy(*key).orderBy("paragraph_start", "paragraph_end")
    reach = F.greatest(F.col("lo") - 1, F.coalesce(F.max("paragraph_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("lo") - 1))
    kept = units.withColumn("__reach", reach).where("paragraph_end > __reach").withColumn("__s", F.greatest("paragraph_start", F.col("__reach") + 1))
    by_start = Window.partitionBy(*key).orderBy("__s")
    moved = kept.withColumns({"scene_index": F.row_number().over(by_start), "__after": F.lead("__s").over(by_start)})
    return moved.withColumns({"paragraph_start": F.when(F.col("scene_index") == 1, F.col("lo")).otherwise(F.col("__s")), "paragraph_end": F.coalesce(F.col("__after") - 1, F.col("hi"))}).drop("__reach", "__s", "__after")
