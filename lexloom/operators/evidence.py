"""Passages around hits: coverage, neighbours, slices and groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom import config


def uncovered(hits: DataFrame, ranges: DataFrame) -> DataFrame:
    """Hits outside every range of their document."""
    h, r = hits.alias("h"), ranges.alias("r")
    return h.join(r, (F.col("h.doc_id") == F.col("r.doc_id")) & F.col("h.paragraph_index").between(F.col("r.paragraph_start"), F.col("r.paragraph_end")), "left_anti")


def neighbours(chosen: DataFrame, scenes: DataFrame, reach: int = 1) -> DataFrame:
    """Scenes within `reach` of a chosen one, without repeats."""
    near = chosen.select("doc_id", F.explode(F.sequence(F.greatest(F.lit(1), F.col("scene_index") - reach), F.col("scene_index") + reach)).alias("scene_index")).distinct()
    return near.join(scenes, ["doc_id", "scene_index"])


def placed(hits: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row for each (query_id, doc_id, paragraph_index), of its highest score, with its first scene and that scene's bounds
    (null outside all)."""
    inside = scenes.select("doc_id", F.struct("scene_index", "paragraph_start", "paragraph_end").alias("scene"), F.explode(F.sequence("paragraph_start", "paragraph_end")).alias("paragraph_index"))
    first = inside.groupBy("doc_id", "paragraph_index").agg(F.min("scene").alias("scene"))
    best = hits.groupBy("query_id", "doc_id", "paragraph_index").agg(F.max("score").alias("score"))
    return best.join(first, ["doc_id", "paragraph_index"], "left").select("query_id", "doc_id", "paragraph_index", "score", "scene")


def clusters(hits: DataFrame, span: int = config.SLICE_SPAN) -> DataFrame:
    """All runs of three or more of a document's placed hits within `span` paragraphs. A hit's run ends are read from a frame of
    at most `span` rows, so a document with many hits needs no group of its own. `scene` is set where all hits share it."""
    frame = Window.partitionBy("query_id", "doc_id").orderBy("paragraph_index").rangeBetween(0, span - 1)
    ahead = hits.withColumn("w", F.collect_list(F.struct(F.col("paragraph_index").alias("p"), "score", "scene")).over(frame)).where("size(w) > 2")
    ends = ahead.select("query_id", "doc_id", "w", F.explode(F.sequence(F.lit(3), F.size("w"))).alias("hits"))
    run = F.slice("w", F.lit(1), F.col("hits"))
    ends = ends.withColumn("hit_start", F.col("w")[0].p).withColumn("hit_end", F.element_at(run, -1).p)
    total = F.round(F.aggregate(run, F.lit(0.0), lambda x, h: x + h.score), 6)
    shared = F.when(F.forall(run, lambda h: h.scene == F.col("w")[0].scene), F.col("w")[0].scene)
    return ends.select("query_id", "doc_id", "hits", total.alias("score"), "hit_start", "hit_end", shared.alias("scene"))


def slice_of(cluster: DataFrame, margin: int, width: int) -> DataFrame:
    """A cluster's slice (lo, hi): its margin on both sides, within its scene if that is not over `width`, at most `width`."""
    scene, hit_span = F.col("scene"), F.col("hit_end") - F.col("hit_start") + 1
    narrow = scene.isNotNull() & (scene.paragraph_end - scene.paragraph_start < width)
    lo, hi = F.greatest(F.lit(1), F.col("hit_start") - margin), F.col("hit_end") + margin
    open_ = cluster.withColumn("lo", F.when(narrow, F.greatest(scene.paragraph_start, lo)).otherwise(lo)).withColumn("hi", F.when(narrow, F.least(scene.paragraph_end, hi)).otherwise(hi))
    centred = F.when(hit_span >= width, F.col("hit_start")).otherwise(F.greatest(F.lit(1), F.col("hit_start") - F.floor((width - hit_span) / 2).cast("int")))
    wide = F.col("hi") - F.col("lo") + 1 > width
    cut = open_.withColumn("from", F.when(wide, F.when((hit_span < width) & (centred + width - 1 < F.col("hit_end")), F.greatest(F.lit(1), F.col("hit_end") - width + 1)).otherwise(centred)).otherwise(F.col("lo")))
    return cut.withColumn("hi", F.when(wide, F.col("from") + width - 1).otherwise(F.col("hi"))).withColumn("lo", F.col("from")).drop("from")


def slices(hits: DataFrame, scenes: DataFrame, most: int = config.SLICES_PER_SEARCH, span: int = config.SLICE_SPAN, margin: int = config.SLICE_MARGIN, width: int = config.SLICE_WIDTH) -> DataFrame:
    """Up to `most` slices for a query: its densest clusters first (then higher scores, shorter, earlier documents, earlier
    places), none that shares a paragraph with one before. A cluster in a scene that goes on behind its slice takes the next
    slice for the scene's rest (reason scene_continuation). Null or non-positive paragraphs are no hits, null scores zero.

    `most` is small, so each choice is one aggregation over all queries; no query's clusters are gathered."""
    usable = hits.where("paragraph_index > 0").withColumn("score", F.coalesce("score", F.lit(0.0)))
    left = slice_of(clusters(placed(usable, scenes), span), margin, width)
    order = F.struct((-F.col("hits")).alias("h"), (-F.col("score")).alias("s"), (F.col("hit_end") - F.col("hit_start")).alias("span"), "doc_id", "hit_start")
    chosen = None
    for _ in range(most):
        used = None if chosen is None else chosen.groupBy("query_id").agg(F.count("*").alias("used"))
        free = left if used is None else left.join(used, "query_id", "left").where(F.coalesce("used", F.lit(0)) < most).drop("used")
        if chosen is not None:
            f, c = free.alias("f"), chosen.alias("c")
            meets = (F.col("f.query_id") == F.col("c.query_id")) & (F.col("f.doc_id") == F.col("c.doc_id")) & (F.greatest("f.hit_start", "c.hit_start") <= F.least("f.hit_end", "c.hit_end"))
            free = f.join(c, meets, "left_anti")
        best = free.groupBy("query_id").agg(F.min_by(F.struct(*left.columns), order).alias("b")).select("b.*")
        at = F.col("lo"), F.col("hi"), F.col("hits"), F.lit("clustered_hits")
        behind = F.col("hi") + 1, F.least(F.col("scene.paragraph_end"), F.col("hi") + width), F.lit(0), F.lit("scene_continuation")
        names = ("paragraph_start", "paragraph_end", "hits", "reason")
        both = best.select("query_id", "doc_id", "hit_start", "hit_end", F.col("scene").isNotNull().alias("goes_on"), F.posexplode(F.array(*(F.struct(*(c.alias(n) for c, n in zip(x, names, strict=True))) for x in (at, behind)))).alias("i", "x"))
        plans = both.where("i = 0 OR (goes_on AND x.paragraph_end > x.paragraph_start)").select("query_id", "doc_id", "hit_start", "hit_end", "x.*")
        if chosen is None:
            chosen = plans if most > 1 else plans.where("reason = 'clustered_hits'")
        else:  # a continuation needs room for both
            room = plans.join(used, "query_id", "left").where((F.col("reason") == "clustered_hits") | (F.coalesce("used", F.lit(0)) + 2 <= most)).drop("used")
            chosen = chosen.unionByName(room)
    return chosen


def groups(hits: DataFrame, lengths: DataFrame, widest: int = config.GROUP_PARAGRAPHS) -> DataFrame:
    """Evidence groups: hits widened by one paragraph, merged while they touch and the group stays within `widest`."""

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for p, n in sorted(set(zip(g["paragraph_index"], g["n"], strict=True))):
            lo, hi = max(1, p - 1), min(n, p + 1)
            if out and lo <= out[-1][1] + 1 and hi - out[-1][0] + 1 <= widest:
                out[-1][1] = max(out[-1][1], hi)
            elif not out or hi > out[-1][1]:
                out.append([max(lo, out[-1][1] + 1) if out else lo, hi])
        q, d = g["query_id"].iloc[0], g["doc_id"].iloc[0]
        return pd.DataFrame([(q, d, f"ev_ch{d}_p{a}_{b}", a, b) for a, b in out], columns=["query_id", "doc_id", "group_id", "paragraph_start", "paragraph_end"])

    return hits.join(lengths, "doc_id").groupBy("query_id", "doc_id").applyInPandas(merge, "query_id int, doc_id long, group_id string, paragraph_start int, paragraph_end int")


def slice_text(paras: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, paragraph_start, paragraph_end, text) of ranges clamped to the document."""
    wanted = ranges.select("doc_id", "paragraph_start", "paragraph_end", F.explode(F.sequence(F.greatest("paragraph_start", F.lit(1)), "paragraph_end")).alias("paragraph_index"))
    joined = wanted.join(paras.select("doc_id", "paragraph_index", "text"), ["doc_id", "paragraph_index"])
    return joined.groupBy("doc_id", "paragraph_start", "paragraph_end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", "text"))), lambda x: x.text), "\n\n").alias("text"))


def in_scope(hits: DataFrame, scope: DataFrame) -> DataFrame:
    """Hits inside the scope's intervals; all of a query's hits if none is."""
    h, s = hits.alias("h"), scope.select("doc_id", "paragraph_start", "paragraph_end").alias("s")
    inside = h.join(s, (F.col("h.doc_id") == F.col("s.doc_id")) & F.col("h.paragraph_index").between(F.col("s.paragraph_start"), F.col("s.paragraph_end")), "left_semi").withColumn("__inside", F.lit(1))
    marked = hits.join(inside.select("query_id", "doc_id", "paragraph_index", "__inside"), ["query_id", "doc_id", "paragraph_index"], "left")
    some = F.count("__inside").over(Window.partitionBy("query_id"))
    return marked.withColumn("__some", some).where("__some = 0 or __inside = 1").drop("__some", "__inside")
