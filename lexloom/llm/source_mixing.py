"""Mixing sources to target weights: hierarchical budgets over a tree of levels, filled from seeded epochs.

Weights go down the tree: a node's budget is shared among its children by weight. A child that has less than its share
passes the rest to its siblings; only what the whole family lacks goes back to the level above, because a node is never
given more than its leaves can supply. A leaf takes whole epochs, then the head of a seeded order of its documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.common import BLANKS

#: Levels from the top: a domain (sources fall into four by their number), the language, the source.
LEVELS: dict[str, str] = {
    "domain": "concat('d', pmod(coalesce(try_cast(regexp_extract(source, '[0-9]+', 0) as bigint), 0), 4))",
    "language": "coalesce(lang, '')",
    "origin": "coalesce(source, '')",
}
#: Documents in a slice of a leaf's order: the slices' token sums are taken first, so that no task holds a whole leaf.
SLICE = 50_000


def tokens_sql(text: str = "text") -> str:
    return f"cast(size(filter(split(coalesce({text}, ''), '{BLANKS.replace(chr(92), chr(92) * 2)}'), w -> w != '')) as long)"


def share(children: DataFrame, parents: list[str]) -> DataFrame:
    """children (parents..., weight, capacity, given: the parent's budget) with `budget`: the given budget by weight, but at
    most the capacity; what some cannot take goes to the others by weight. One pass over the siblings by capacity a weight:
    a child is full if an equal rate for all that are not yet full would give it more than it has."""
    order = [F.expr("capacity / weight"), *[c for c in children.columns if c not in ("weight", "capacity", "given")]]
    before = Window.partitionBy(*parents).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parents).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    rated = children.withColumn("rate", (F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    full = rated.withColumn("full", F.expr("capacity <= weight * rate"))
    # the rate at the first child that is not full, the greatest of theirs, holds for all after it
    return full.withColumn("least", F.max(F.when(~F.col("full"), F.col("rate"))).over(Window.partitionBy(*parents))).withColumn(
        "budget", F.expr("if(full, capacity, weight * least)")
    ).drop("rate", "full", "least", "given")


def kept_leaves(leaves: DataFrame, levels: list[str], weights: DataFrame | None) -> DataFrame:
    """The leaves that a mixture may take (levels..., tokens, and by depth __said1 to __saidN: the weight that `weights` names for
    the node). Going down, siblings that are not named beside one that is fall away, and so do those of no weight."""
    kept = leaves
    for depth in range(1, len(levels) + 1):
        said = f"__said{depth}"
        if weights is None:
            kept = kept.withColumn(said, F.lit(None).cast("double"))
            continue
        named = weights.groupBy(F.col("path").alias("__path")).agg(F.max(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias(said))
        family = kept.join(named, F.concat_ws("/", *levels[:depth]) == F.col("__path"), "left").drop("__path")
        any_named = F.max(F.col(said).isNotNull()).over(Window.partitionBy(*(levels[: depth - 1] or [F.lit(0)])))
        kept = family.withColumn("__any", any_named).where(f"NOT __any OR {said} > 0").drop("__any")
    return kept


def leaf_budgets(leaves: DataFrame, levels: list[str], total: Column, exponent: float, epochs: float, weights: DataFrame | None = None) -> DataFrame:
    """Token budget of each leaf that may be taken (levels..., budget). A leaf can supply `epochs` times its tokens, and a node
    what its leaves can; leaves that may not be taken supply nothing, so a shortage goes to siblings that have more.

    A node's weight among its siblings is what `weights` (path, weight) says of its path, the names from the top joined by /.
    Siblings that are not named there beside one that is get nothing; nor does a weight that is null or not above 0. Where
    no sibling is named, the weight is the token count to the power `exponent`: 1 keeps the shares, 0 makes siblings equal.
    """
    kept = kept_leaves(leaves, levels, weights)
    top = leaves.agg(F.sum("tokens").cast("double").alias("all")).crossJoin(kept.agg((F.sum("tokens").cast("double") * epochs).alias("most")))  # one row each
    above = top.select(F.least(total.cast("double"), "most").alias("given"))
    for depth in range(1, len(levels) + 1):
        here = kept.groupBy(*levels[:depth]).agg(F.sum("tokens").cast("double").alias("size"), F.max(f"__said{depth}").alias("said"))
        here = here.select(*levels[:depth], F.coalesce("said", F.pow("size", F.lit(exponent))).alias("weight"), (F.col("size") * epochs).alias("capacity"))
        here = here.crossJoin(F.broadcast(above)) if depth == 1 else here.join(above, levels[: depth - 1])  # above the top there is one row
        shared = share(here, levels[: depth - 1] or [F.lit(0)])
        above = shared.select(*levels[:depth], F.col("budget").alias("given"))
    return above.withColumnRenamed("given", "budget")


def mix(docs: DataFrame, share_of_tokens: float = 0.9, exponent: float = 0.7, epochs: float = 2.0, seed: int = 17, levels: dict[str, str] | None = None, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, the levels, n_tokens and copies (how often the mixture takes the document, 0 if not at all) of every row.

    The whole mixture has `share_of_tokens` of the tokens there are, or all that named nodes can supply if that is less. Target weights of
    domains, languages and sources come from `weights` (see leaf_budgets). Epoch e of a leaf is its documents in the order of
    md5(seed:e:doc_id); the last, partial epoch takes the longest head of it that fits the rest of the budget. Tokens
    are words between blanks; a document without any costs nothing and is taken while its turn comes within the budget,
    and a leaf without any is not taken. Null languages and sources count as empty names, null texts as empty; repeated
    rows are counted and ordered one by one, those of one doc_id by their tokens. A leaf's order is summed in slices of about
    SLICE documents if it were all of them, so a hot leaf is no single task. Columns of docs besides doc_id, text, lang and
    source matter only to `levels` of your own.
    """
    names = list(levels or LEVELS)
    light = docs.select("doc_id", *(F.expr(e).alias(n) for n, e in (levels or LEVELS).items()), F.expr(tokens_sql()).alias("n_tokens"))
    leaves = light.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    budgets = leaf_budgets(leaves, names, F.col("all") * share_of_tokens, exponent, epochs, weights).join(leaves, names)
    plan = budgets.select(*names, F.expr("cast(floor(budget / tokens) as int) as full"), F.expr("budget - floor(budget / tokens) * tokens as rest"))
    ranked = light.join(plan, names, "left").withColumn("h", F.expr(f"md5(concat({seed}, ':', coalesce(full, 0) + 1, ':', coalesce(cast(doc_id as string), '')))"))
    ranked = ranked.withColumn("slice", F.substring("h", 1, max(2, math.ceil(math.log(max(docs.count(), 1) / SLICE, 16)))))  # hexadecimal digits
    before = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = ranked.groupBy(*names, "slice").agg(F.sum("n_tokens").alias("here")).select(*names, "slice", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(*names, "slice").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranked.join(slices, [*names, "slice"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
    return placed.select("doc_id", *names, "n_tokens", F.expr("coalesce(full + if(upto <= rest, 1, 0), 0)").alias("copies"))


def mixture(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs as often as the mixture takes them. doc_id names documents here: rows that repeat one are taken
    alike, as often as the most taken of them, and rows without doc_id are left out."""
    taken = mix(docs, **parameters).where("copies > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies"))
    joined = docs.join(taken, docs.doc_id == F.col("__id"))
    return joined.withColumn("__copy", F.explode(F.expr("sequence(1, __copies)"))).select(*docs.columns)
