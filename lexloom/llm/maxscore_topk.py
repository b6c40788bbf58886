"""Exact top-k inner products by MaxScore, in blocks of queries against shards of candidates.

The dimensions are the terms. A shard keeps a posting list for each: its candidates in order of the dimension's value. For a
query each dimension has bounds on what it adds to a score. Once k full scores are known, the dimensions of least spread
whose bounds together cannot lift a candidate over the k-th of them are non-essential. A candidate that can still win must
reach its share of the rest in some essential dimension, so only the heads of the essential posting lists are traversed;
what they hold is scored on the essential dimensions, and the others are probed while a candidate competes. The shards'
lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Scores of vectors that a float64 holds exactly are computed in floats.
EXACT = 2.0**53


def quantized(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and q: floor(scale * x) of each component as double. Vectors that are null or hold a null or non-finite
    component, or an id that is null, are left out."""
    finite = "embedding is not null and vec_id is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return vectors.where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> cast(floor(cast(x as double) * {scale}D) as double))").alias("q"))


class Shard:
    """Candidates (rows of equal length, ordered by vec_id) and their posting lists by dimension."""

    def __init__(self, ids: np.ndarray, cand: np.ndarray):
        self.ids, self.cand = ids, cand
        self.order = np.argsort(cand, axis=0, kind="stable")  # a posting list in each column, by rising value
        self.sorted = np.take_along_axis(cand, self.order, axis=0)

    def head(self, d: int, q: float, n: int) -> np.ndarray:
        """The n candidates to which dimension d adds most."""
        return self.order[-n:, d] if q > 0 else self.order[:n, d]

    def over(self, d: int, q: float, least: float) -> np.ndarray:
        """The candidates to which dimension d adds `least` or more; a little more of the list where division rounds."""
        edge = least / q
        slack = 1e-9 * (1 + abs(edge))
        if q > 0:
            return self.order[np.searchsorted(self.sorted[:, d], edge - slack) :, d]
        return self.order[: np.searchsorted(self.sorted[:, d], edge + slack, "right"), d]

    def best(self, q: np.ndarray, query_id: int, k: int, step: int = 16) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best but the query's own, ties to the smaller vec_id."""
        alive = np.flatnonzero(self.ids != query_id)
        if len(alive) > 8 * k and q.any():
            ends = np.stack([q * self.sorted[0], q * self.sorted[-1]])
            low, high = ends.min(axis=0), ends.max(axis=0)
            spread = high - low
            order = np.argsort(-spread, kind="stable")
            # k full scores, of those to which the widest dimensions add most
            probe = np.unique(np.concatenate([self.head(d, q[d], 2 * k) for d in order[:4]]))
            probe = probe[self.ids[probe] != query_id]
            if len(probe) >= k:
                least = np.partition(self.cand[probe] @ q, len(probe) - k)[-k]  # the k-th best is no less
                needed = least - low.sum()  # over what every candidate has
                rest = np.concatenate([np.cumsum(spread[order][::-1])[::-1], [0.0]])  # what dimensions from here on can add
                n = min(max(1, int(np.searchsorted(-rest, -needed, "right"))), len(order))  # the others cannot bring it alone
                essential, short = order[:n], needed - rest[n]
                wide = spread[essential].sum()
                if short > 0 and wide > 0:
                    reached = np.zeros(len(self.ids), bool)
                    for d in essential[q[essential] != 0]:
                        reached[self.over(d, q[d], low[d] + short * spread[d] / wide)] = True
                    alive = alive[reached[alive]]
                partial = self.cand[np.ix_(alive, essential)] @ q[essential]
                above = np.concatenate([np.cumsum(high[order][::-1])[::-1], [0.0]])
                for at in range(n, len(order), step):
                    stays = partial + above[at] >= least
                    alive, use = alive[stays], order[at : at + step]
                    partial = partial[stays] + self.cand[np.ix_(alive, use)] @ q[use]
        score = self.cand[alive] @ q
        top = np.lexsort((self.ids[alive], -score))[:k]
        return [(int(self.ids[alive[j]]), int(score[j])) for j in top]


def best_in_shard(queries: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, cand: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best in the shard, ties to the smaller vec_id; cand is ordered by vec_id."""
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(cand).max(initial=0)) * max(cand.shape[1], 1) < EXACT
    if exact:
        shard = Shard(ids, cand)
        for q, i in zip(queries, query_ids.tolist(), strict=True):
            yield from ((i, v, s) for v, s in shard.best(q, i, k))
        return
    # beyond what floats hold: Python integers, all candidates
    whole = [[int(x) for x in row] for row in cand]
    for q, i in zip(([int(x) for x in row] for row in queries), query_ids.tolist(), strict=True):
        scored = sorted((-sum(a * b for a, b in zip(q, row, strict=True)), v) for row, v in zip(whole, ids.tolist(), strict=True) if v != i)[:k]
        yield from ((i, v, -s) for s, v in scored)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, query_block: int = 1024, shard: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each vector whose vec_id is divisible by `every`.

    Queries lie in blocks of about `query_block`, candidates in shards of about `shard`; a task holds one of each. Blocks
    and shards come from hashes of the ids, so repeated vectors spread evenly. A repeated vec_id competes as often as it
    occurs (never against itself), and asks once, with its least vector. An empty table gives an empty result.
    """
    cand = quantized(vectors)
    n = cand.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n // (every * query_block)))
    asked = cand.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    part = lambda seed, parts: F.expr(f"cast(pmod(xxhash64(vec_id, {seed}), {parts}) as int)")
    left = asked.select("vec_id", "q", part(11, blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = cand.select("vec_id", "q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part(12, shards).alias("shard"))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        b = b.sort_values("vec_id", kind="stable")
        rows = []
        for size, c in b.groupby(b["q"].map(len)):  # vectors of another length have no inner product
            if len(same := a[a["q"].map(len) == size]):
                rows += best_in_shard(np.stack(same["q"].to_list()), c["vec_id"].to_numpy(), same["vec_id"].to_numpy(), np.stack(c["q"].to_list()), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
