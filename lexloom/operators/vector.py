"""Exact cosine retrieval, window means and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom import config
from lexloom.functions.text import half_up


#: What an approximate cosine may be off by, and what rounding to six digits may make equal, with room to spare; pairs at a time.
MARGIN, PAIRS = 2e-5, 4_000_000


def guarded(vectors: DataFrame, dims: int = 64) -> DataFrame:
    """Vectors of the right length, as doubles with their norm; a null component counts as 0."""
    ok = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims))
    return ok.withColumn("v", F.transform("embedding", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return pc.fill_null(column.combine_chunks().flatten(), 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def best_pairs(v: np.ndarray, norm: np.ndarray, q: np.ndarray, qnorm: np.ndarray, k: int, ids: np.ndarray | None = None, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of queries and of their k best vectors, and the cosines to six digits (ties: the vector that stands first; 0 where there is
    none), without the vectors whose id is the query's own. A product of matrices finds what can be among the best; the sums that
    count are made component by component, so blocks and their order change nothing."""
    with np.errstate(all="ignore"):
        unit, asked = (np.nan_to_num(x / n[:, None], nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32) for x, n in ((v, norm), (q, qnorm)))
        columns, step = np.ascontiguousarray(v.T), max(1, PAIRS // max(1, len(v)))
        for at in range(0, len(q) if len(v) else 0, step):
            near = asked[at : at + step] @ unit.T
            if ids is not None:
                near[own[at : at + step, None] == ids] = -np.inf
            least = np.partition(near, len(v) - k, axis=1)[:, len(v) - k] if k < len(v) else np.full(len(near), -2, np.float32)
            row, col = np.nonzero(near >= np.maximum(least, -2)[:, None] - np.float32(MARGIN))
            done = []
            for i in range(0, len(row), PAIRS):
                r, c = row[i : i + PAIRS] + at, col[i : i + PAIRS]
                dot = np.zeros(len(r))
                for d in range(len(columns)):
                    dot += columns[d][c] * q[r, d]
                done.append(np.nan_to_num(np.floor(dot / (norm[c] * qnorm[r]) * 1e6 + 0.5) / 1e6, nan=0.0))
            score = np.concatenate(done) if done else np.zeros(0)
            order = np.lexsort((col, -score, row))
            row, col, score = row[order] + at, col[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            yield row[place < k], col[place < k], score[place < k]


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, dims: int = 64, blocks: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score, eligible) for a stated query set; eligible counts the candidates before the limit.

    Candidates are dealt to blocks by their ids and every query goes to every block. A block multiplies its candidates with the queries,
    some millions of pairs at a time, and keeps k a query, so neither memory nor what is shuffled grows with the pairs."""
    c = guarded(vectors, dims).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"), "norm")
    q = guarded(queries, dims).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("asked"), F.col("norm").alias("qnorm"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).where("query_id IS NOT NULL")
    n = c.agg(F.count("*").alias("all"))
    blocked = c.where("vec_id IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def block(units: pa.Table, asked: pa.Table) -> pa.Table:
        units = units.sort_by("vec_id")
        ids, own = units["vec_id"].to_numpy(), asked["query_id"].to_numpy()
        found = best_pairs(matrix(units["embedding"], dims), units["norm"].to_numpy(), matrix(asked["asked"], dims), asked["qnorm"].to_numpy(), k, ids, own) if len(ids) and len(own) else ()
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(ids[c]), pa.array(s)], schema=schema) for r, c, s in found], schema)

    pairs = blocked.groupBy("block").cogroup(q.groupBy("block")).applyInArrow(block, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kind = vectors.schema["vec_id"].dataType
    return ranked.crossJoin(F.broadcast(n)).select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("vec_id").cast(kind).alias("vec_id"), "score", (F.col("all") - 1).alias("eligible"))  # one row


def window_means(vectors: DataFrame, size: int = 5, overlap: int = 2) -> DataFrame:
    """(label, start, dim, mean): element-wise average over overlapping windows of a label's vectors in order of id."""
    numbered = vectors.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    ends = numbered.groupBy("label").agg(F.max("i").alias("n"))
    last = F.greatest(F.lit(1), F.col("n") - size + 1)
    starts = ends.select("label", F.explode(F.array_union(F.filter(F.sequence(F.lit(1), F.col("n"), F.lit(size - overlap)), lambda s: s <= last), F.array(last))).alias("start"))
    members = starts.select("label", "start", F.explode(F.sequence("start", F.col("start") + size - 1)).alias("i"))
    values = members.join(numbered, ["label", "i"]).select("label", "start", F.posexplode("embedding").alias("dim", "x"))
    return values.groupBy("label", "start", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def confidence(ranked: DataFrame) -> DataFrame:
    """(query_id, confidence) from the best and third best score."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    pivot = ranked.where("rank in (1, 3)").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 3, F.col("score"))).alias("c"))
    return pivot.select("query_id", half_up(0.75 * unit((F.col("a") - 0.22) / 0.3) + 0.25 * unit((F.col("a") - F.coalesce("c", F.lit(0.0))) / 0.12), 6).alias("confidence"))


def fused(semantic: DataFrame, lexical: DataFrame, weights: tuple[float, float] = config.RRF_WEIGHTS, k: int = config.RRF_K) -> DataFrame:
    """(query_id, ref, score, rank) of two ranked lists (query_id, ref, rank); a list that lacks a ref adds nothing."""
    s, x = semantic.select("query_id", "ref", F.col("rank").alias("sr")), lexical.select("query_id", "ref", F.col("rank").alias("lr"))
    part = lambda w, r: F.coalesce(w / (k + F.col(r)), F.lit(0.0))
    both = s.join(x, ["query_id", "ref"], "full").withColumn("score", half_up(part(weights[0], "sr") + part(weights[1], "lr"), 6))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ref"))).select("query_id", "ref", "score", "rank")


def merged_queries(hits: DataFrame) -> DataFrame:
    """(ref, score, queries): best score over the queries that found a ref, and those queries in order."""
    return hits.groupBy("ref").agg(F.max("score").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_set("query_id")), lambda x: x.cast("string")), ",").alias("queries"))


def filled_up(candidates: DataFrame, reranked: DataFrame, k: int) -> DataFrame:
    """(query_id, ref, position): reranked refs by score, then the rest in their former order, k in all."""
    joined = candidates.join(reranked.select("query_id", "ref", F.col("score").alias("rerank")), ["query_id", "ref"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("rerank").isNull(), F.desc("rerank"), "rank", "ref")
    return joined.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("query_id", "ref", "position")
