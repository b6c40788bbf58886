"""Prices and costs, roll-ups of stages, versions and attempts, the contract of ranking anew, and turns from older records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as T
from lexloom.operators import intake

#: The share of the price that cached input costs, dollars for a thousand ranking calls, and exchange rates.
CACHED, RERANK_1000, USD_EUR, EUR_RUB = 0.1, 1.0, 0.92, 107.0
#: Stages of a run in order, and candidates and characters sent to a ranking model.
STAGES = ("paragraphs", "scenes", "scene_embeddings", "fragments", "finalize")
SENT, CONTENT = 80, 3200
_RANK = {"failed": 3, "running": 2, "completed": 1}


def priced(usage: DataFrame, catalogue: DataFrame, fallback: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """usage (model, ...) with input_price and output_price (dollars for a million tokens) from a catalogue (pattern, place,
    input_price, output_price): of the model's own entry, else of the first by place whose pattern ends in * and begins the
    model's name, else the fallback; so is a price that is null or below 0. Names are compared trimmed and without case.
    Prices are looked up for the distinct models only; Spark broadcasts the catalogue, a configuration, by its size."""
    name = F.lower(F.trim(F.coalesce("model", F.lit(""))))
    models = usage.select(name.alias("__model")).distinct()
    c = catalogue.select(F.lower(F.trim("pattern")).alias("__p"), "place", "input_price", "output_price")
    fits = (F.col("__p") == F.col("__model")) | (F.col("__p").endswith("*") & F.startswith("__model", F.expr("left(__p, length(__p) - 1)")))
    first = F.min_by(F.struct("input_price", "output_price"), F.struct(F.col("__p") != F.col("__model"), "place"))
    found = models.where("__model <> ''").join(c, fits).groupBy("__model").agg(first.alias("__price"))
    joined = usage.withColumn("__model", name).join(found, "__model", "left")
    price = lambda c, otherwise: F.when(F.col(f"__price.{c}") >= 0, F.col(f"__price.{c}")).otherwise(otherwise).alias(c)
    return joined.select(*usage.columns, price("input_price", fallback[0]), price("output_price", fallback[1]))


def cost(input_tokens: Column, cached: Column, output: Column, input_price: Column, output_price: Column, factor: float = CACHED) -> Column:
    """Dollars of a call: cached input, at most all of it, costs a share of the price; output holds what was thought as well."""
    some = lambda x: F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)).cast("double")
    held = F.least(some(cached), some(input_tokens))
    return (some(input_tokens) - held) / 1e6 * input_price + held / 1e6 * input_price * min(1.0, max(0.0, factor)) + some(output) / 1e6 * output_price


def stage_rollup(metrics: DataFrame, key: list[str], order: str, sums: list[str]) -> DataFrame:
    """metrics by chapter (key..., order, state, started, completed, error, storage: a map of bytes, sums...) rolled up by key: sums,
    the worst state, first start, last end, the first error by order if any chapter failed, and the summed map. The maps' entries are
    summed by kind first, so no group gathers more rows than there are kinds."""
    rank = F.coalesce(*(F.when(F.col("state") == s, r) for s, r in _RANK.items()), F.lit(0))
    said = F.col("error").isNotNull() & (F.col("error") != "")
    rolled = metrics.groupBy(*key).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums), F.max(rank).alias("__worst"), F.min("started").alias("started"), F.max("completed").alias("completed"), F.min_by(F.when(said, F.col("error")), F.when(said, F.col(order))).alias("__error"))
    state = F.when(F.col("__worst") == 3, "failed").when(F.col("__worst") == 2, "running").when(F.col("__worst") == 1, "completed").otherwise("queued")
    bytes_of = metrics.select(*key, F.explode("storage").alias("kind", "bytes")).groupBy(*key, "kind").agg(F.greatest(F.lit(0), F.sum("bytes")).alias("bytes"))
    maps = bytes_of.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "bytes")))).alias("storage"))
    error = F.when(F.col("__worst") == 3, F.coalesce("__error", F.lit("Stage failed")))
    out = rolled.join(maps, key, "left").withColumns({"state": state, "error": error, "storage": F.coalesce("storage", F.create_map().cast("map<string,bigint>"))})
    return out.select(*key, *sums, "state", "started", "completed", "error", "storage")


def current_stage(stages: DataFrame, run: str, done: Column) -> DataFrame:
    """(run, current_stage) of stages (run, stage, state): the last stage of a run that is done; else the first in STAGES that
    failed, else the first that runs, else the first that waits, else the last stage."""
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    urgency = F.when(F.col("state") == "failed", 1).when(F.col("state") == "running", 2).when(F.col("state") == "queued", 3)
    at = F.when(urgency.isNotNull() & (place > 0), F.struct(urgency.alias("u"), place.alias("p"), F.col("stage").alias("s")))
    first = stages.groupBy(run).agg(F.min(at).alias("f"), F.bool_or(done).alias("__done"))
    return first.select(run, F.when(F.col("__done"), STAGES[-1]).otherwise(F.coalesce("f.s", F.lit(STAGES[-1]))).alias("current_stage"))


def versions(uploads: DataFrame, stored: DataFrame, book: str, order: list[str], sha: str) -> DataFrame:
    """uploads with version and attempt: a file equal to the book's latest version has that version, another the next one;
    attempts count the uploads of a version behind those stored. stored (book, version, sha, attempts) has all earlier versions. The
    latest version is always the upload before, so a change is seen by one row's lag; trailing blanks of hashes do not matter."""
    last = stored.groupBy(book).agg(F.max_by(F.struct(F.col("version").alias("v"), F.trim(sha).alias("h"), F.col("attempts").alias("n")), "version").alias("__last"))
    w = Window.partitionBy(book).orderBy(*order)
    joined = uploads.join(last, book, "left").withColumn("__h", F.trim(F.coalesce(sha, F.lit(""))))
    before = F.coalesce(F.lag("__h").over(w), F.col("__last.h"))
    changed = joined.withColumn("__new", F.when(before.isNotNull() & (before == F.col("__h")), 0).otherwise(1))
    version = F.coalesce("__last.v", F.lit(0)) + F.sum("__new").over(w)
    numbered = changed.withColumn("version", version.cast("long"))
    nth = F.row_number().over(Window.partitionBy(book, "version").orderBy(*order))
    return numbered.withColumn("attempt", (nth + F.when(F.col("version") == F.col("__last.v"), F.col("__last.n")).otherwise(0)).cast("long")).select(*uploads.columns, "version", "attempt")


def ranked_anew(candidates: DataFrame, status: DataFrame, model: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """(query_id, ref, place, rerank, used, error): the k best candidates (query_id, ref, rank, id, title, content) of each query.

    At most 80 are sent, those with an id and some text, their contents cut and their ids made unique; `model` gives
    (query_id, unique_id, score) for them. What it scores comes first, by score, then what else was sent. Where the
    query's status (query_id, enabled, failure) is off or failed, or nothing was sent or scored, the candidates stay as they were."""
    placed = candidates.withColumn("position", F.col("rank") - 1).where(F.col("rank") <= SENT)
    full = (F.coalesce("id", F.lit("")) != "") & ((F.coalesce("title", F.lit("")) != "") | (F.coalesce("content", F.lit("")) != ""))
    dense = placed.where(full).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1).withColumn("content", T.clamped(F.col("content"), CONTENT))
    sent = intake.unique_ids(dense, "query_id", "id", "position")
    asked = sent.join(status.where("enabled AND failure IS NULL").select("query_id"), "query_id", "left_semi")
    scores = model(asked).groupBy("query_id", "unique_id").agg(F.max("score").alias("rerank"))
    met = asked.join(scores, ["query_id", "unique_id"], "left")
    some = met.groupBy("query_id").agg(F.count("rerank").alias("hits"), F.count("*").alias("n_sent"))
    state = status.join(some, "query_id", "left").withColumn("used", F.coalesce(F.col("hits") > 0, F.lit(False)))
    error = F.when(~F.col("enabled"), None).otherwise(F.coalesce("failure", F.when((F.col("n_sent") > 0) & (F.col("hits") == 0), "empty rerank result")))
    state = state.select("query_id", "used", error.alias("error"))
    whole = candidates.select("query_id", "ref", "rank").join(state, "query_id").join(met.select("query_id", "ref", "rerank", F.lit(True).alias("__sent")), ["query_id", "ref"], "left")
    kept = whole.where("NOT used OR __sent").withColumn("rerank", F.when(F.col("used"), F.col("rerank")))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank").isNull(), F.desc("rerank"), "rank")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "ref", "place", "rerank", "used", "error")


def explicit(record: Column, field: str, computed: Column, kind: str = "double") -> Column:
    """A field of a turn's JSON record if it holds a number of at least 0 there, else what is computed."""
    said = F.get_json_object(record, f"$.{field}").try_cast("double")
    return F.coalesce(F.when(said >= 0, said), computed.cast("double")).cast(kind)
