"""Personal data: high-recall generators, boosted trees on format and context, calibrated thresholds (DataFrame operations only).

Base spans are the matches of four patterns that pass their checks. Generators then propose further, overlapping spans;
gradient-boosted trees, trained here on made-up examples of known kind, score each from its format and the words before
it, and the spans over the kind's calibrated threshold are added. The trees are applied as CASE expressions, in the row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import sql_text

# The base patterns, by kind in the order of the output. The groups are possessive where nothing follows
# that could need their characters back: the same matches, without recursion on very long runs. Mail and ip start where a
# run of their first characters does, or at the last match's end: a start inside a run meets the same end of it, so the
# matches are the same, and a long run is gone through once.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "@", "true"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", ".", "m rlike '^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\\\\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$'"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "", "length({digits}) between 16 and 19 and {luhn} % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", "length({digits}) between 8 and 15"),
}
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = f"aggregate(transform(split(reverse({_DIGITS}), ''), (x, i) -> if(i % 2 = 1, element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(x as int) + 1), cast(x as int))), 0, (a, x) -> a + coalesce(x, 0))"

#: Generators by kind of the span they propose: pattern, and what a text must contain to be searched ('': nothing).
GENERATORS = {
    "email": (r"[A-Za-z0-9._%+-]{1,64}+(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+)++", "at"),
    "phone": (r"[(0-9][(0-9][\x20()./0-9-]{5,24}[0-9]", ""),
    "secret": (r"[A-Za-z0-9_+/=-]{20,}+", ""),
}
KINDS = (*BASE, "secret")
#: Matches whose offsets are summed together, and characters of the parts that a text is cut into.
BLOCK, PART = 256, 1024
#: Characters before a span that are searched for telling words.
CONTEXT = 24
#: Features of a proposed span; m: its text, c: the lower-cased text before it.
FEATURES = {
    "n_chars": "length(m)",
    "n_digits": f"length({_DIGITS})",
    "n_letters": "length(regexp_replace(m, '[^A-Za-z]', ''))",
    "n_upper": "length(regexp_replace(m, '[^A-Z]', ''))",
    "n_hex": "length(regexp_replace(m, '[^0-9a-fA-F]', ''))",
    "n_switches": "length(regexp_replace(regexp_replace(m, '[A-Za-z]++', 'a'), '[^a0-9]', ''))",
    "n_marks": "length(regexp_replace(m, '[A-Za-z0-9]', ''))",
    "n_dots": "length(regexp_replace(m, '[^.]', ''))",
    "n_slashes": "length(regexp_replace(m, '[^/]', ''))",
    "parens": "length(regexp_replace(m, '[^()]', ''))",
    "longest_part": "array_max(transform(split(m, '[^0-9]'), x -> length(x)))",
    "says_phone": "if(c rlike '(?:tel|phone|call|fax|mobile|cell)[^a-z]{0,4}$', 1, 0)",
    "says_mail": "if(c rlike '(?:mail|contact|write|to)[^a-z]{0,4}$', 1, 0)",
    "says_secret": "if(c rlike '(?:token|secret|password|passwd|api.?key|access.?key)[^a-z]{0,6}$', 1, 0)",
    "says_other": "if(c rlike '(?:date|version|isbn|order|page|item|no)[^a-z]{0,4}$', 1, 0)",
}


def _found(pattern: str, needs: str) -> str:
    """SQL: matches of the pattern in t, leftmost and not overlapping, as structs of m, s and e (code points, end exclusive).

    Offsets are summed in blocks of BLOCK matches, then over the blocks, as a fold that appends costs the square of its length.
    """
    p = sql_text(pattern)
    gate = f"instr(t, {sql_text(needs)}) > 0 and " if needs else ""
    pieces = f"transform(array(regexp_extract_all(t, {p}, 0)), x -> zip_with(x, slice(split(t, {p}, -1), 1, size(x)), (m, g) -> named_struct('m', m, 'g', length(g), 'n', length(m))))[0]"
    none = "cast(array() as array<struct<m:string,s:int,e:int>>)"
    summed = f"aggregate(b, named_struct('at', 0, 'found', {none}), (a, x) -> named_struct('at', a.at + x.g + x.n, 'found', concat(a.found, array(named_struct('m', x.m, 's', a.at + x.g, 'e', a.at + x.g + x.n)))))"
    blocks = f"transform(array({pieces}), p -> transform(sequence(0, (size(p) - 1) div {BLOCK}), i -> transform(array(slice(p, i * {BLOCK} + 1, {BLOCK})), b -> {summed})[0]))[0]"
    bases = "aggregate(q, named_struct('at', 0, 'all', cast(array() as array<int>)), (a, x) -> named_struct('at', a.at + x.at, 'all', concat(a.all, array(a.at))), a -> a.all)"
    moved = f"transform(array({blocks}), q -> flatten(zip_with(q, {bases}, (x, base) -> transform(x.found, f -> named_struct('m', f.m, 's', f.s + base, 'e', f.e + base)))))[0]"
    return f"if({gate}t rlike {p}, {moved}, {none})"


def _part(start: str, length: str) -> str:
    """SQL: substring of the text that is cut into __pii_blocks, from a 0-based start on. A substring of the whole text is
    sought from its beginning, which costs the square of the length where there are many."""
    return f"substring(array_join(slice(__pii_blocks, ({start}) div {PART} + 1, greatest(({start} + {length} - 1) div {PART} - ({start}) div {PART} + 1, 0)), ''), ({start}) % {PART} + 1, {length})"


def _blocks(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).{{1,{PART}}}', 0)"


@dataclass(frozen=True)
class SpanModel:
    """A score over FEATURES as SQL (of struct f), and the least score by kind that is taken."""

    score: str
    thresholds: dict[str, float]


_models: dict[tuple, SpanModel] = {}


def train(spark: SparkSession, rows: int = 3000, rounds: int = 10, depth: int = 3, precision: float = 0.98) -> SpanModel:
    """Boosted trees fitted to made-up spans of known kind (none of them from the corpus), `rows` in all. The shapes marked as
    held are not fitted to: on them each kind's least score is chosen at which `precision` of the taken spans are right, so
    the precision is that on shapes which the trees have not seen."""
    key = (rows, rounds, depth, precision)
    if key not in _models:
        made = _examples(spark, rows)
        fit = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(made.where("not held")).coalesce(1)
        model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32).fit(fit)
        score = " + ".join(f"{w!r} * ({_tree_sql(t.toDebugString)})" for w, t in zip(model.treeWeights, model.trees, strict=True))
        held = made.where("held").withColumn("f", F.struct(*FEATURES)).select("kind", "label", F.expr(f"round({score}, 6)").alias("score"))
        by_score = held.groupBy("kind", "score").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
        _models[key] = SpanModel(score, {k: _least([r for r in by_score if r.kind == k], precision) for k in GENERATORS})
    return _models[key]


def _least(rows: list, precision: float) -> float:
    best, good, n = float("inf"), 0, 0
    for r in sorted(rows, key=lambda r: -r.score):
        good, n = good + r.good, n + r.n
        if good >= precision * n:
            best = r.score
    return max(best, 0.0)  # a score below 0 means that the trees think it unlikely


def _tree_sql(shown: str) -> str:
    """CASE expression of a regression tree as MLlib shows it."""
    names, lines = list(FEATURES), [x.strip() for x in shown.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]

    def node() -> str:
        line = lines.pop(0)
        if m := re.match(r"Predict: (\S+)", line):
            return f"{float(m[1])!r}D"
        feature, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        yes = node()
        lines.pop(0)  # the matching Else
        return f"if(f.{names[int(feature)]} <= {float(cut)!r}D, {yes}, {node()})"

    return node()


def _examples(spark: SparkSession, rows: int) -> DataFrame:
    """Spans as generators propose them, made from a seeded hash: id, kind, m, c, label, held, features."""
    r = lambda k, n: f"pmod(xxhash64(id, {k}), {n})"
    d = lambda k, n: f"lpad(cast({r(k, 10**n)} as string), {n}, '0')"
    word = lambda k: f"element_at(array('lorem','dolor','river','table','stone','garden','paper','window'), cast({r(k, 8)} + 1 as int))"
    shapes = [
        ("email", 1, f"concat({word(1)}, '.', {d(2, 2)}, ' (at) ', {word(3)}, '.example.com')", "'mail: '"),
        ("email", 1, f"concat({word(1)}, ' [at] ', {word(3)}, ' [dot] org')", f"concat({word(4)}, ' ')"),
        ("email", 0, f"concat({word(1)}, ' at ', {word(3)}, '.', {word(5)})", f"concat({word(4)}, ' ')"),
        ("email", 0, f"concat({word(1)}, ' at ', {word(3)}, ' dot ', {word(5)})", "'look '"),
        ("phone", 1, f"concat('(', {d(1, 3)}, ') ', {d(2, 3)}, '-', {d(3, 4)})", f"concat({word(4)}, ' ')"),
        ("phone", 1, f"concat({d(1, 3)}, '-', {d(2, 3)}, '-', {d(3, 4)})", "'tel. '"),
        ("phone", 1, f"concat('0', {d(1, 3)}, ' ', {d(2, 3)}, ' ', {d(3, 4)})", "'call '"),
        ("phone", 0, f"concat('20', {d(1, 2)}, '-0', {r(2, 9)} + 1, '-1', {r(3, 9)})", f"concat({word(4)}, ' ')"),
        ("phone", 0, f"concat({d(1, 2)}, '/', {d(2, 2)}, '/20', {d(3, 2)})", "'date '"),
        ("phone", 0, d(1, 16), f"concat({word(4)}, ' ')"),
        ("phone", 0, f"concat({d(1, 3)}, '.', {d(2, 3)}, '.', {d(3, 2)}, '.', {d(5, 3)})", f"concat({word(4)}, ' ')"),
        ("phone", 0, f"concat({d(1, 5)}, ' ', {d(2, 6)}, ' ', {d(3, 5)})", f"concat({word(4)}, ' ')"),
        ("phone", 0, f"concat('978-', {d(1, 1)}, '-', {d(2, 5)}, '-', {d(3, 3)}, '-', {d(5, 1)})", "'isbn '"),
        ("secret", 1, "sha1(cast(id as string))", "'token = \"'"),
        ("secret", 1, "md5(cast(id as string))", "'api_key: '"),
        ("secret", 1, "substring(base64(sha2(cast(id as string), 256)), 1, 40)", "'secret='"),
        ("secret", 1, "sha1(cast(id as string))", f"concat({word(4)}, ' ')"),
        ("secret", 0, f"concat({word(1)}, '-', {word(2)}, '-', {word(3)}, '-', {word(5)}, '-', {word(6)})", f"concat({word(4)}, ' ')"),
        ("secret", 0, f"concat({word(1)}, {word(2)}, {word(3)}, {word(5)}, {word(6)})", f"concat({word(4)}, ' ')"),
        ("secret", 0, f"repeat(element_at(array('=', '-', '_', '/'), cast({r(1, 4)} + 1 as int)), cast(20 + {r(2, 60)} as int))", "''"),
        ("secret", 0, d(1, 16), "'order '"),
        ("secret", 0, f"concat({d(1, 15)}, {d(2, 15)})", f"concat({word(4)}, ' ')"),
    ]
    unseen = [
        ("email", 1, f"concat({word(1)}, '_', {word(2)}, ' (at) ', {word(3)}, '.', {word(5)}, '.net')", "'contact '"),
        ("email", 1, f"concat({word(1)}, {d(2, 3)}, '[at]', {word(3)}, '[dot]com')", f"concat({word(4)}, ': ')"),
        ("email", 0, f"concat({word(1)}, ' at ', {word(3)}, '.', {word(5)}, '.', {word(6)})", f"concat({word(4)}, ', ')"),
        ("phone", 1, f"concat('(0', {d(1, 2)}, ') ', {d(2, 4)}, ' ', {d(3, 4)})", "'phone '"),
        ("phone", 1, f"concat({d(1, 3)}, ' ', {d(2, 3)}, ' ', {d(3, 4)})", "'mobile: '"),
        ("phone", 0, f"concat({d(1, 4)}, '.', {d(2, 2)}, '.', {d(3, 2)}, ' ', {d(5, 2)})", "'version '"),
        ("phone", 0, f"concat({d(1, 4)}, ' ', {d(2, 4)}, ' ', {d(3, 4)}, ' ', {d(5, 4)})", f"concat({word(4)}, ' ')"),
        ("secret", 1, "concat('sk_', md5(cast(id as string)))", "'token: '"),
        ("secret", 1, "substring(base64(sha2(concat(id, 'x'), 256)), 1, 32)", "'password '"),
        ("secret", 0, f"concat({word(1)}, '/', {word(2)}, '/', {word(3)}, '/', {word(5)}, '/', {word(6)})", f"concat({word(4)}, ' ')"),
        ("secret", 0, f"concat({word(1)}, '_', {word(2)}, '_', {word(3)}, '_', {word(5)}, '_', {d(1, 2)})", "'page '"),
    ]
    shape = "array(" + ", ".join(f"named_struct('kind', '{k}', 'label', {y}D, 'held', {str(held).lower()}, 'm', {m}, 'c', {c})" for held, group in ((False, shapes), (True, unseen)) for k, y, m, c in group) + ")"
    made = spark.range(rows).select("id", F.expr(f"element_at({shape}, cast(pmod(xxhash64(id, 99), {len(shapes) + len(unseen)}) + 1 as int))").alias("x")).select("id", "x.*")
    return made.withColumns({n: F.expr(f"cast({e} as double)") for n, e in FEATURES.items()})


def find_spans(docs: DataFrame, model: SpanModel | None = None, text: str = "text") -> DataFrame:
    """docs with __pii_base (kind, s, e by kind as listed in BASE, then start) and __pii_all (by start, end, kind).

    Offsets count code points, ends are exclusive. Proposed spans that lie inside a base span are left out: what is found
    there already counts; one that reaches beyond is judged like any other. A null or empty text has no spans. Rows are
    judged one by one, repeated rows alike; an empty table gives an empty result. Columns __pii_* are overwritten.
    """
    model = model or train(docs.sparkSession)
    checks = {k: c.replace("{digits}", _DIGITS).replace("{luhn}", _LUHN) for k, (_, _, c) in BASE.items()}
    base = "concat(" + ", ".join(f"transform(filter(__pii_{k}, x -> transform(array(x.m), m -> {checks[k]})[0]), x -> named_struct('kind', '{k}', 's', x.s, 'e', x.e))" for k in BASE) + ")"
    near = f"lower({_part(f'greatest(x.s - {CONTEXT}, 0)', f'least(x.s, {CONTEXT})')})"
    features = "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in FEATURES.items()) + ")"
    scored = lambda k: f"""filter(__pii_more_{k}, x -> not exists(__pii_base, b -> b.s <= x.s and x.e <= b.e)
        and transform(array({near}), c -> transform(array(x.m), m -> transform(array({features}), f -> {model.score})[0])[0])[0] >= {model.thresholds[k]!r}D)"""  # noqa: E731
    more = "concat(" + ", ".join(f"transform({scored(k)}, x -> named_struct('kind', '{k}', 's', x.s, 'e', x.e))" for k in GENERATORS) + ")"
    out = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("__pii_blocks", F.expr(_blocks("t")))
    out = out.withColumns({f"__pii_{k}": F.expr(_found(p, needs)) for k, (p, needs, _) in BASE.items()})
    out = out.withColumns({f"__pii_more_{k}": F.expr(_found(p, needs)) for k, (p, needs) in GENERATORS.items()})
    out = out.withColumn("__pii_base", F.expr(base))
    out = out.withColumn("__pii_all", F.expr(f"concat(__pii_base, {more})"))
    return out.select("__row.*", "__pii_base", F.expr("array_sort(transform(__pii_all, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))").alias("__pii_all"))


def _joined(spans: str) -> str:
    """SQL: the spans as kind:start:end, by kind in the fixed order, then start."""
    order = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    by_kind = f"array_sort(transform({spans}, x -> named_struct('k', array_position({order}, x.kind), 's', x.s, 'e', x.e, 'kind', x.kind)))"
    return f"array_join(transform({by_kind}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def span_report(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans (all of them) of every row; a null
    or empty text has none of either."""
    found = find_spans(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", *(F.expr(f"cast(size(filter(__pii_base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE),
        F.expr(f"sha2({_joined('__pii_base')}, 256)").alias("base_sha256"), F.expr(_joined("__pii_all")).alias("spans"),
    )


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """docs with each found span's text replaced by its kind in angle brackets; overlapping spans become one, named by the
    first. n_chars follows the new text where the table has it. A null text stays null."""
    found = find_spans(docs, model).withColumn("__pii_blocks", F.expr(f"if(size(__pii_all) = 0, array(), {_blocks('text')})"))
    cut = f"""aggregate(__pii_all, named_struct('at', 0, 'text', array('')), (a, x) -> if(x.e <= a.at, a,
        named_struct('at', greatest(x.e, a.at), 'text', if(x.s < a.at, a.text, concat(a.text, array({_part('a.at', 'x.s - a.at')}, concat('<', x.kind, '>')))))),
        a -> array_join(concat(a.text, array(substring(text, a.at + 1))), ''))"""
    out = found.withColumn("text", F.expr(f"if(text is null or size(__pii_all) = 0, text, {cut})"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.expr("if(size(__pii_all) = 0, n_chars, cast(length(text) as long))"))
    return out.select(*docs.columns)
