"""Ingest and request rules over tables: blocks, parsed segmentation, ids, query pools, quotas and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import rules
from lexloom.functions import text as T
from lexloom.operators import segment


def block_offsets(docs: DataFrame) -> DataFrame:
    """(doc_id, block, start_char, end_char, text): the blocks of canonical texts, which empty lines part, with their places in
    code points. In a canonical text the gap between two blocks is two characters, so places are sums of lengths."""
    parts = docs.select("doc_id", F.posexplode(F.split(T.canonical(F.col("text")), r"\n\n(?=\S)")).alias("i", "text")).where("text <> ''")
    before = F.sum(F.length("text") + 2).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("int")
    return parts.select("doc_id", (F.col("i") + 1).alias("block"), start.alias("start_char"), (start + F.length("text")).alias("end_char"), "text")


def search_units(lines: DataFrame, facts: int = 12, anchors: int = 8) -> DataFrame:
    """Segmentation lines (with columns line, lo, hi) to paragraph_start, paragraph_end, summary, beats, anchors and error; lines
    that hold no unit go: fences, fewer than five parts, no numbers. Parts stand between tabs, or bars where there is no tab; the
    range is one part (with any dash) or two. A unit outside lo to hi, or without summary, beats or anchors, keeps an error."""
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    parts = F.transform(F.when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, r"\|")), trim)
    rows = lines.withColumn("p", parts).where(~line.startswith("```") & (F.size(parts) >= 5))
    both = r"^(\d+)\s*[-–—]\s*(\d+)$"
    ranged, number = F.get("p", F.lit(0)).rlike(both), r"^([+-]?\d+)"
    first = F.when(ranged, F.regexp_extract(F.get("p", F.lit(0)), both, 1)).otherwise(F.regexp_extract(F.get("p", F.lit(0)), number, 1))
    last = F.when(ranged, F.regexp_extract(F.get("p", F.lit(0)), both, 2)).otherwise(F.regexp_extract(F.get("p", F.lit(1)), number, 1))
    at = F.when(ranged, 1).otherwise(2)
    rest = F.array_join(F.slice("p", at + 3, F.size("p")), "; ")
    read = rows.withColumns({"paragraph_start": F.try_to_number(first, F.lit("S9999999999")).cast("int"), "paragraph_end": F.try_to_number(last, F.lit("S9999999999")).cast("int"),
                             "summary": F.get("p", at), "beats": rules.listed(F.get("p", at + 1), facts), "anchors": rules.listed(rest, anchors)})
    outside = (F.col("paragraph_start") < F.col("lo")) | (F.col("paragraph_end") > F.col("hi")) | (F.col("paragraph_start") > F.col("paragraph_end"))
    error = F.when(outside, "outside").when(F.col("summary") == "", "no summary").when(F.size("beats") == 0, "no beats").when(F.size("anchors") == 0, "no anchors")
    return read.where("paragraph_start IS NOT NULL AND paragraph_end IS NOT NULL").withColumn("error", error).drop("p")


def segmentation(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses (segment_id, content, lo, hi) to their scenes and their errors. A response with a bad unit, or with none, gives no
    scene but one row (segment_id, line, error): its first bad line from 1, or no line. The units of the others are repaired
    to follow on each other from lo to hi: (segment_id, scene_index, paragraph_start, paragraph_end, summary, beats, anchors)."""
    lines = responses.select("segment_id", "lo", "hi", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\r?\n")).alias("line_no", "line"))
    units = search_units(lines).withColumn("line_no", F.col("line_no") + 1)
    bad = units.where("error IS NOT NULL").groupBy("segment_id").agg(F.min(F.struct(F.col("line_no").alias("line"), "error")).alias("e")).select("segment_id", "e.line", "e.error")
    any_unit = units.select("segment_id").distinct()
    empty = F.when(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", "") == "", "empty response").otherwise("no units")
    none = responses.join(any_unit, "segment_id", "left_anti").select("segment_id", F.lit(None).cast("int").alias("line"), empty.alias("error"))
    good = units.join(bad.select("segment_id"), "segment_id", "left_anti")
    names = ["segment_id", "scene_index", "paragraph_start", "paragraph_end", "summary", "beats", "anchors"]
    return segment.repaired_within(good, ["segment_id"]).select(*names), bad.unionByName(none)


def strict_segmentation(units: DataFrame) -> DataFrame:
    """The strict form: units (segment_id, lo, hi, paragraph_start, paragraph_end) are not repaired. One row for each segment that
    breaks the rules, with the first broken one: a unit outside, a gap, an overlap, a start or an end that is not the segment's."""
    order = Window.partitionBy("segment_id").orderBy("paragraph_start", "paragraph_end")
    before, after = F.lag("paragraph_end").over(order), F.lead("paragraph_start").over(order)
    outside = (F.col("paragraph_start") < F.col("lo")) | (F.col("paragraph_end") > F.col("hi")) | (F.col("paragraph_start") > F.col("paragraph_end"))
    error = F.when(outside, "outside").when(before.isNull() & (F.col("paragraph_start") != F.col("lo")), "start").when(F.col("paragraph_start") > before + 1, "gap").when(F.col("paragraph_start") <= before, "overlap").when(after.isNull() & (F.col("paragraph_end") != F.col("hi")), "end")
    judged = units.withColumn("error", error).where("error IS NOT NULL")
    return judged.groupBy("segment_id").agg(F.min_by("error", F.struct("paragraph_start", "paragraph_end")).alias("error"))


def unique_ids(rows: DataFrame, group: str, raw: str, position: str) -> DataFrame:
    """Adds unique_id: the trimmed id (record_<position> where it is blank), and for its repeats within a group how many came
    before and the position. Positions count from 0."""
    base = F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.concat(F.lit("record_"), F.col(position).cast("string")))
    before = F.row_number().over(Window.partitionBy(group, "__base").orderBy(position)) - 1
    named = rows.withColumn("__base", base).withColumn("__before", before)
    return named.withColumn("unique_id", F.when(F.col("__before") == 0, F.col("__base")).otherwise(F.concat_ws("_", "__base", F.lit("_dup"), "__before", position))).drop("__base", "__before")


def query_pool(queries: DataFrame, group: str, order: list[str], most: int = 8) -> DataFrame:
    """The first `most` (16 at most) different queries of a group in order, blank ones left out; case and runs of white space make
    no difference. A query's first place is found by partial aggregation before places are ranked."""
    text = F.regexp_replace("query", r"^\s+|\s+$", "")
    keyed = queries.withColumn("query", text).where("query <> ''").withColumn("same", F.regexp_replace(F.lower("query"), r"\s+", " "))
    first = keyed.groupBy(group, "same").agg(F.min(F.struct(*order, "query")).alias("f")).select(group, "f.*")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order, "query"))
    return first.withColumn("place", rank).where(F.col("place") <= max(1, min(16, most))).select(group, "place", "query")


def with_slots(requests: DataFrame, owned: DataFrame, slots: int = 5) -> DataFrame:
    """Library additions (user_id, item, at) judged in order: an item is added once, and only while what the user owns (user_id,
    n) and has added is under `slots`. Gives user_id, item, place, added."""
    first = requests.groupBy("user_id", "item").agg(F.min("at").alias("at"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("at", "item")))
    return placed.join(owned, "user_id", "left").select("user_id", "item", "place", (F.coalesce("n", F.lit(0)) + F.col("place") <= slots).alias("added"))


def guarded(demotions: DataFrame, holders: DataFrame, scope: str, order: str) -> DataFrame:
    """Demotions judged in order: the last holder of a role in its scope stays."""
    left = holders.groupBy(scope).agg(F.count("*").alias("__held"))
    nth = F.row_number().over(Window.partitionBy(scope).orderBy(order))
    return demotions.withColumn("__nth", nth).join(left, scope).withColumn("allowed", F.col("__nth") < F.col("__held")).drop("__nth", "__held")


def limited(requests: DataFrame, key: str, at: str, order: str, limit: int, seconds: int) -> DataFrame:
    """Fixed-window limits: adds allowed, remaining and retry_after (whole seconds to the window's end where denied, 1 at least).
    The window is part of the key, so a key's requests are spread over its windows."""
    epoch = F.unix_micros(F.col(at).cast("timestamp"))
    window = F.floor(epoch / (seconds * 1_000_000))
    n = F.row_number().over(Window.partitionBy(key, "__window").orderBy(at, order))
    counted = requests.withColumn("__window", window).withColumn("__nth", n)
    wait = F.greatest(F.lit(1), F.ceil(((F.col("__window") + 1) * seconds * 1_000_000 - epoch) / 1_000_000)).cast("int")
    nth = F.col("__nth")
    return counted.withColumn("allowed", nth <= limit).withColumn("remaining", F.greatest(F.lit(limit) - nth, F.lit(0))).withColumn("retry_after", F.when(nth <= limit, 0).otherwise(wait)).drop("__window", "__nth")


def batch_after(rows: DataFrame, key: str, cursor: int, n: int) -> DataFrame:
    """The next n rows behind a cursor, by key: a filter that reaches the scan and a top-n, no full sort."""
    return rows.where(F.col(key) > cursor).orderBy(key).limit(n)


def either_join(left: DataFrame, right: DataFrame, keys: tuple[list[str], list[str]], take: list[str]) -> DataFrame:
    """left with the columns `take` of the rows of right that agree in all of the first or in all of the second keys: what a left
    join on an OR of both gives where each is unique in right. An OR has no hash join; these are two equi joins. A left row that
    both keys lead to the same right row comes once, to different ones twice, to none once with nulls."""
    row = F.struct(*take)
    by = [right.where(" AND ".join(f"`{k}` IS NOT NULL" for k in ks)).select(*ks, F.struct(F.struct(*sorted({*keys[0], *keys[1]})).alias("id"), row.alias("row")).alias(f"__r{i}")) for i, ks in enumerate(keys)]
    both = left.join(by[0], keys[0], "left").join(by[1], keys[1], "left")
    found = F.array_distinct(F.filter(F.array("__r0", "__r1"), lambda x: x.isNotNull()))
    return both.withColumn("__m", F.explode_outer(found)).select(*left.columns, *(F.col(f"__m.row.{c}").alias(c) for c in take))


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Filters by what is given: None or 0 asks for nothing, a list for any of its values, name_min and name_max for bounds."""
    for name, value in wanted.items():
        if value in (None, 0, []):
            continue
        if name.endswith("_min"):
            rows = rows.where(F.col(name[:-4]) >= value)
        elif name.endswith("_max"):
            rows = rows.where(F.col(name[:-4]) <= value)
        else:
            rows = rows.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return rows


def page(rows: DataFrame, order: list[str | Column], number: int, size: int) -> DataFrame:
    """A page of rows in an order, numbered from 1, with the number of all rows in `total`."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def citations(groups: DataFrame, order: str, most: int = 8, chars: int = 220) -> DataFrame:
    """The first `most` different places of a query's evidence in order, with clamped text; evidence outside scenes is none."""
    place = ["query_id", "doc_id", "scene_index", "paragraph_start", "paragraph_end"]
    first = groups.where("scene_index > 0").groupBy(*place).agg(F.min(F.struct(order, "text")).alias("f"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("f")[order], "doc_id", "scene_index", "paragraph_start", "paragraph_end"))
    return first.withColumn("place", n).where(F.col("place") <= most).select(*place, "place", F.coalesce(F.nullif(T.clamped(F.col("f.text"), chars), F.lit("")), F.lit("evidence")).alias("reason"))


def rerank_calls(runs: DataFrame, price_per_1000: float) -> DataFrame:
    """The billed calls of runs (enabled, used, error, records, returned, latency): those used, or with an error; only used ones
    cost. Runs that sent no record and met no error were no calls."""
    error = F.trim(F.coalesce("error", F.lit("")))
    call = runs.where(F.col("enabled") & (F.coalesce("used", F.lit(False)) | (error != "")))
    positive = {c: F.greatest(F.lit(0), F.floor(F.coalesce(F.col(c), F.lit(0.0)) + 0.5)).cast("long") for c in ("records", "returned", "latency")}
    return call.withColumns(positive | {"cost_usd": F.when(F.col("used"), price_per_1000 / 1000).otherwise(0.0), "error": F.when(~F.coalesce("used", F.lit(False)), error)})
