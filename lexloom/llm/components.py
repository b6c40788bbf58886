"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import written

#: Tasks that a node's links are dealt to.
SALTS = 4


def _least(links: DataFrame) -> DataFrame:
    """links (u, v) and m: the least of u and all its neighbours. The minimum is summed before the shuffle, and a node's
    links are dealt to SALTS tasks, so that one with very many is no single task; beyond that Spark splits the join."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return links.withColumn("salt", F.expr(f"cast(pmod(xxhash64(v), {SALTS}) as int)")).join(least, ["u", "salt"]).select("u", "v", "m")


def _stars(pairs: DataFrame) -> bool:
    """Whether each id has a single link down, to an id that has none, or none itself: then nothing is left to do."""
    ends = pairs.selectExpr("inline(array(named_struct('id', u, 'down', 1), named_struct('id', v, 'down', 0)))")
    unsettled = ends.groupBy("id").agg(F.sum("down").alias("down"), F.min("down").alias("least")).where("down > 1 or (down = 1 and least = 0)")
    return not unsettled.agg(F.count("*")).first()[0]


def components(links: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every id that links (a, b) hold; both directions count. Links that hold
    a null or one id twice say nothing; without any the result is empty. Each star step is written once and read again:
    what reads it twice would run it twice, and every task of every stage is kept by the driver for a while."""
    pairs = written(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(pairs):
        both = pairs.selectExpr("inline(array(named_struct('u', u, 'v', v), named_struct('u', v, 'v', u)))")
        large = written(_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())  # u above v
        small = _least(large).selectExpr("inline(array(named_struct('u', v, 'v', m), named_struct('u', u, 'v', m)))")
        pairs = written(small.where("u <> v").distinct())
    roots = pairs.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
