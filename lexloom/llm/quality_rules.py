"""Quality rules with risk-controlled thresholds (DataFrame operations only).

Every document gets its counts and the base rule. On top, the rules of RULES may reject. Their cutoffs are tightened step by
step in an order that is fixed beforehand: the loosest cutoff of each rule in turn, then the next ones. Per stratum each
step is tested on a labelled holdout: an exact binomial test must show that all rules together, with the cutoffs so far,
reject at most the tolerated share of good documents. The first step that fails the test ends the sequence, so the steps
need no correction among themselves; the strata that occur share the error probability (Bonferroni).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import BLANKS, sql_text, written

#: Rules by name: value and the cutoffs from the loosest on; a document fails the rule if its value is above the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1L)", (0.3, 0.15, 0.08, 0.04, 0.02, 0.01)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1L)", (0.9, 0.7, 0.5, 0.35, 0.25, 0.15)),
    "repeats": ("n_repeat_words / greatest(n_words, 1L)", (0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "long_words": ("word_chars / greatest(n_words, 1L)", (10.0, 8.0, 7.5, 7.0, 6.5, 6.0)),
    "short_words": ("-word_chars / greatest(n_words, 1L)", (-2.0, -3.0, -3.4, -3.7, -4.0, -4.3)),
}
_OWN = "__quality_"
#: What the cutoffs are fitted on.
_FITTED = ("stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")


def with_counts(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, their names prefixed.

    n_repeat_words: words that lie in a 3-word window found twice or more in the text. A null or empty text has no words,
    so it fails the base rule. Words and windows are compared as they are, without lower-casing.
    """
    p = prefix
    text = "coalesce(text, '')"
    staged = docs.withColumn(f"{p}words", F.expr(f"filter(split({text}, {sql_text(BLANKS)}), w -> w != '')"))
    staged = staged.withColumn(f"{p}lines", F.expr(f"filter(split({text}, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    # windows as strings: words hold no blanks, so joining by one keeps them apart
    windows = f"""slice(zip_with(zip_with({p}words, slice({p}words, 2, size({p}words)), (a, b) -> concat(a, ' ', b)),
        slice({p}words, 3, size({p}words)), (ab, c) -> concat(ab, ' ', c)), 1, greatest(size({p}words) - 2, 0))"""
    starts = f"""transform(array(array_sort(transform({p}tri, (s, i) -> struct(s, i)))), x -> array_sort(array_distinct(flatten(
        zip_with(slice(x, 1, size(x) - 1), slice(x, 2, size(x) - 1), (a, b) -> if(a.s = b.s, array(a.i, b.i), array()))))))[0]"""
    covered = f"transform(array({starts}), y -> aggregate(zip_with(y, slice(y, 2, size(y)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (t, x) -> t + x))[0]"
    counted = staged.withColumn(f"{p}tri", F.expr(windows)).withColumns({
        f"{p}n_words": F.size(f"{p}words").cast("long"),
        f"{p}word_chars": F.expr(f"cast(length({text}) - regexp_count({text}, '[\\\\x20\\\\x09-\\\\x0D]') as long)"),
        f"{p}n_symbols": F.expr(f"cast(regexp_count({text}, '[#*$%&|<>]') as long)"),
        f"{p}n_lines": F.size(f"{p}lines").cast("long"),
        f"{p}n_dup_lines": F.expr(f"cast(size({p}lines) - size(array_distinct({p}lines)) as long)"),
        f"{p}n_repeat_words": F.expr(f"if(size(array_distinct({p}tri)) = size({p}tri), 0L, {covered})"),
    }).drop(f"{p}words", f"{p}lines", f"{p}tri")
    return counted.withColumn(f"{p}base_failed", F.expr(f"{p}n_words < 50 or 100 * {p}n_repeat_words > 50 * {p}n_words"))


def admissible(k: str, n: str, risk: float, error: str) -> Column:
    """Whether k rejections among n good documents show, but for the error probability (SQL), that at most `risk` are rejected.

    The exact (Clopper-Pearson) upper bound on the rejection rate is at most `risk` just if P(Bin(n, risk) <= k) <= error;
    the tail is summed in logarithms.
    """
    odds, stay = math.log(risk / (1 - risk)), math.log1p(-risk)
    tail = f"""aggregate(sequence(0L, least({k}, cast(ceil({n} * {risk}) as bigint))), named_struct('p', cast({n} * {stay!r} as double), 's', cast({n} * {stay!r} as double)),
        (a, j) -> if(j = 0, a, transform(array(a.p + ln(({n} - j + 1) / j) + {odds!r}), p -> named_struct('p', p, 's', greatest(a.s, p) + ln(1 + exp(-abs(a.s - p)))))[0]), a -> a.s)"""
    return F.expr(f"if({n} > 0 and {k} <= {n} * {risk}, {tail} <= ln({error}), false)")


def steps() -> list[tuple[str, float]]:
    """Rule and cutoff of each step, in the fixed order."""
    rounds = max(len(cuts) for _, cuts in RULES.values())
    return [(rule, cuts[n]) for n in range(rounds) for rule, (_, cuts) in RULES.items() if n < len(cuts)]


def first_step_sql() -> str:
    """SQL: the number of the first step (from 1) whose cutoff rejects the counted document, one more than all if none does."""
    numbers = {step: i for i, step in enumerate(steps(), 1)}
    cases = [" ".join(f"when {_prefixed(value)} > {cut!r}D then {numbers[rule, cut]}" for cut in cuts) for rule, (value, cuts) in RULES.items()]
    return "least(" + ", ".join(f"case {c} else {len(numbers) + 1} end" for c in cases) + ")"


def fit_cutoffs(holdout: DataFrame, stratum: str, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """stratum and `allowed`, the number of steps in force, from counted holdout rows with `quality`.

    risk: share of the good documents that pass the base rule which all rules together may reject. error: the probability
    that this fails in any stratum; each of those that occur in the holdout gets an equal part. A stratum with too few good
    documents to show anything has no step in force, so the rules reject nothing there.
    """
    # written once: what follows reads it several times, and a filter on the counts would be pushed below the holdout's join
    tried = written(holdout.where("quality = 1").select(F.col(stratum).alias("stratum"), F.expr(first_step_sql()).alias("first"), f"{_OWN}base_failed"))
    counts = tried.where(f"not {_OWN}base_failed").groupBy("stratum", "first").agg(F.count("*").alias("k")).groupBy("stratum").agg(F.sum("k").alias("n"), F.collect_list(F.struct("first", "k")).alias("firsts"))  # one for each step at most
    strata = counts.agg(F.count("*").alias("strata"))
    tested = counts.crossJoin(F.broadcast(strata)).select("stratum", "n", "strata", F.explode(F.sequence(F.lit(1), F.lit(len(steps())))).alias("step"), "firsts")  # one row
    tested = tested.withColumn("k", F.expr("aggregate(filter(firsts, x -> x.first <= step), 0L, (a, x) -> a + x.k)"))
    failed = tested.where(~admissible("k", "n", risk, f"{error!r}D / strata")).groupBy("stratum").agg((F.min("step") - 1).alias("allowed"))
    return counts.select("stratum").join(failed, "stratum", "left").select("stratum", F.coalesce("allowed", F.lit(len(steps()))).alias("allowed"))


def _prefixed(value: str) -> str:
    for c in ("n_symbols", "word_chars", "n_dup_lines", "n_lines", "n_repeat_words", "n_words"):
        value = value.replace(c, f"{_OWN}{c}")
    return value


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: Column | None = None, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """docs with __quality_* counts, __quality_base_failed and __quality_kept.

    The holdout is all labelled doc_ids; labels repeated for a doc_id count as their greatest, and null ones not at all.
    What the cutoffs are fitted on is written without texts, so no text is shuffled; the texts are counted again for the
    verdicts. Documents of a null language are a stratum of their own, and so is each language; one without labels has no
    cutoffs. Every row is judged by its own text, repeated rows too; an empty table gives an empty result. Columns of docs
    named __quality_* are overwritten; no other name clashes.
    """
    counted = _counted(docs, stratum)
    tried = written(counted.where("doc_id is not null").select("doc_id", *(f"{_OWN}{c}" for c in _FITTED)))
    return _judged(counted, _cutoffs(tried, labels, risk, error))


def _counted(docs: DataFrame, stratum: Column | None) -> DataFrame:
    key = F.coalesce(F.col("lang"), F.lit("")) if stratum is None else stratum
    return with_counts(docs.withColumn(f"{_OWN}stratum", key), _OWN)


def _cutoffs(counted: DataFrame, labels: DataFrame, risk: float, error: float) -> DataFrame:
    """__quality_of and __quality_allowed by all labels, from counted rows without texts: the strata that have steps in
    force. Each takes dozens of good documents to show its risk, so there are far fewer of them than labels."""
    best = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias(f"{_OWN}id")).agg(F.max("quality").alias("quality"))
    held = counted.join(best, F.col("doc_id") == F.col(f"{_OWN}id"))
    return fit_cutoffs(held, f"{_OWN}stratum", risk, error).where("allowed > 0").toDF(f"{_OWN}of", f"{_OWN}allowed")


def _judged(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """counted and __quality_kept, without the columns that only the verdict needs."""
    judged = counted.join(F.broadcast(cuts), F.col(f"{_OWN}stratum") == F.col(f"{_OWN}of"), "left")
    kept = F.expr(f"not {_OWN}base_failed and {first_step_sql()} > coalesce({_OWN}allowed, 0)")
    return judged.withColumn(f"{_OWN}kept", kept).drop(f"{_OWN}of", f"{_OWN}allowed", f"{_OWN}stratum")


def quality_report(docs: DataFrame, labels: DataFrame, stratum: Column | None = None, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of docs; nulls, repeats and ties as in apply_rules. The counts
    are written once, without texts, and read for the cutoffs and for the verdicts."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    counted = written(_counted(docs, stratum).select("doc_id", f"{_OWN}stratum", f"{_OWN}n_lines", *(f"{_OWN}{c}" for c in names[:-1])))
    return _judged(counted, _cutoffs(counted, labels, risk, error)).select("doc_id", *(F.col(f"{_OWN}{c}").alias(c) for c in names))


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns.

    The verdict decides by exploding to one row or none: a filter would be pushed below the counts, and each count in
    it be worked out again.
    """
    once = F.explode(F.expr(f"if({_OWN}kept, array(1), cast(array() as array<int>))"))
    return apply_rules(docs, labels, **parameters).withColumn(f"{_OWN}one", once).select(*docs.columns)
