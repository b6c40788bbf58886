"""Lexical retrieval over a table of queries: BM25, fuzzy terms, phrases and character n-grams."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom import config
from lexloom.functions import text as T


def tokens(paras: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, paragraph_index, len, term): a row for each term of a paragraph, made without a shuffle, and with an outer
    explosion, so that the terms are found once (see segment.paragraphs). `by` names further columns to keep."""
    counted = paras.select(*by, "doc_id", "paragraph_index", T.terms(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    return counted.select(*by, "doc_id", "paragraph_index", "len", F.explode_outer("t").alias("term")).where("term IS NOT NULL")


def postings(toks: DataFrame, wanted: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, paragraph_index, term, tf, len) of tokens; with `wanted` (distinct terms) only theirs, so that no other token
    is shuffled. Spark broadcasts `wanted` or not by its size."""
    some = toks if wanted is None else toks.join(wanted, [*by, "term"])
    return some.groupBy(*by, "doc_id", "paragraph_index", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def term_stats(paras: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(term, df, cf) over all paragraphs (for each value of `by`). A paragraph's terms are sorted and counted in its row, so only partial sums by
    term are shuffled."""
    rows = paras.select(*by, F.array_sort(T.terms(F.col("text"))).alias("t"))
    at = rows.select(*by, F.posexplode_outer("t").alias("i", "term"), "t").where("term IS NOT NULL")
    first = (F.col("i") == 0) | (F.element_at("t", F.greatest(F.col("i"), F.lit(1))) != F.col("term"))
    return at.groupBy(*by, "term").agg(F.sum(first.cast("long")).alias("df"), F.count("*").alias("cf"))


def corpus_stats(paras: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of `by`): paragraphs with a term, and their average number of terms (1 at least)."""
    n = F.size(T.terms(F.col("text")))
    return paras.select(*by, n.alias("len")).where("len > 0").groupBy(*by).agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.greatest(F.coalesce(F.avg("len"), F.lit(1.0)), F.lit(1.0)).alias("avgdl"))


def query_terms(queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, term, ord) of the distinct terms in order."""
    return queries.select("query_id", *by, F.posexplode(F.array_distinct(T.terms(F.col("query")))).alias("ord", "term"))


def frequencies(posts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(term, df). It reads all columns of posts, so that this use and the scores' have the same plan and share one shuffle."""
    return posts.groupBy(*by, "term").agg(F.count(F.when((F.col("len") > 0) & (F.col("tf") > 0), 1)).alias("df"))


def weight(tf: str = "tf"):
    """A term's part of BM25, from columns df, n, avgdl, len and tf."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col(tf) + config.BM25_K1 * (1 - config.BM25_B + config.BM25_B * F.greatest(F.col("len"), F.lit(1)) / F.col("avgdl"))
    return idf * F.col(tf) * (config.BM25_K1 + 1) / norm


def bm25(paras: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, paragraph_index, bm25, exact): scores of paragraphs with a query's term. Tokens are filtered by the
    queries' terms before they are shuffled; both uses of the counts read one exchange."""
    asked = query_terms(queries)
    posts = postings(tokens(paras), asked.select("term").distinct())
    df = frequencies(posts)
    scored = posts.join(df, "term").join(asked, "term").crossJoin(F.broadcast(corpus_stats(paras)))  # one row
    return scored.groupBy("query_id", "doc_id", "paragraph_index").agg(F.sum(weight()).alias("bm25"), F.count("*").alias("exact"))


def top(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc(by), "doc_id", "paragraph_index")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _cuts(size: int) -> list[tuple[int, int, int]]:
    """The three parts (number, bounds) of a term that can have two edits."""
    return [(i, i * size // 3, (i + 1) * size // 3) for i in range(3)] if size >= 6 else []


def _less(t: str) -> set[str]:
    """A term that can have one edit, and what it is without one of its characters."""
    return {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))} if 3 <= len(t) <= 7 else set()


def _likely(terms: list[str], asked: list[str]) -> list[tuple[str, str]]:
    """Pairs of unequal terms that may be near. Where both are of 3 to 7 characters, one edit leaves them equal without a character; else
    one of three parts of a term stands in the other, moved by no more places than there can be edits."""
    known: dict[tuple, set[str]] = {}
    for q in asked:
        m = len(q)
        for x in _less(q):
            known.setdefault(x, set()).add(q)
        for size in range(max(6, m - config.FUZZY_DISTANCE, 0 if m >= 8 else 8), m + config.FUZZY_DISTANCE + 1):
            for i, a, b in _cuts(size):
                for at in range(max(0, a - 2), min(a + 2, m - b + a) + 1):
                    known.setdefault((size, i, q[at : at + b - a]), set()).add(q)
    out = []
    for t in terms:
        found = set().union(*(known.get(x, ()) for x in _less(t)), *(known.get((len(t), i, t[a:b]), ()) for i, a, b in _cuts(len(t))))
        out += [(t, q) for q in found if q != t]
    return out


def fuzzy_terms(vocabulary: DataFrame, asked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(qterm, term, similarity) of near but unequal terms among vocabulary (term) and asked (qterm), both distinct: distance at most
    2, lengths alike, similarity over the threshold, which leaves terms of under 8 characters one edit. Only likely pairs are compared."""
    buckets = 8 if by else 64
    v = vocabulary.select(*by, "term", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
    q = asked.select(*by, "qterm", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    kinds = {c: vocabulary.schema[c].dataType.simpleString() for c in by}

    def likely(terms: pa.Table, wanted: pa.Table) -> pa.Table:
        pairs = _likely(terms["term"].to_pylist(), wanted["qterm"].to_pylist()) if wanted.num_rows else []
        of = [pa.array([terms[c][0].as_py()] * len(pairs), terms[c].type) if terms.num_rows else pa.array([], terms[c].type) for c in by]
        return pa.Table.from_arrays([*of, pa.array([q for _, q in pairs], pa.string()), pa.array([t for t, _ in pairs], pa.string())], names=[*by, "qterm", "term"])

    near = v.groupBy(*by, "bucket").cogroup(q.groupBy(*by, "bucket")).applyInArrow(likely, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "qterm string", "term string"]))
    found = near.withColumn("d", F.levenshtein("term", "qterm", config.FUZZY_DISTANCE)).where("d >= 0").withColumn("similarity", 1 - F.col("d") / F.greatest(F.length("term"), F.length("qterm")))
    return found.where(F.col("similarity") >= config.FUZZY_ACCEPT).select(*by, "qterm", "term", T.half_up(F.col("similarity"), 6).alias("similarity"))


def fuzzy_vocabulary(vocabulary: DataFrame, queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, qterm, term, similarity) of the queries' terms and near ones of the vocabulary. It runs over distinct terms, not postings."""
    asked = query_terms(queries, by).withColumnRenamed("term", "qterm")
    near = fuzzy_terms(vocabulary, asked.select(*by, "qterm").distinct(), by)
    return asked.join(near, [*by, "qterm"]).select("query_id", *by, "qterm", "term", "similarity")


def full_score(paras: DataFrame, queries: DataFrame, matched: bool = False, scope: str | None = None) -> DataFrame:
    """(query_id, doc_id, paragraph_index, score): BM25 weighted by coverage, phrase, fuzzy terms and n-gram overlap; kept
    if the signal is over the least for the query's length, or with the phrase. n-grams are made of kept rows only.
    Only tokens equal or near to a query's term are counted; a term's exact hit in a paragraph rules out its fuzzy ones.
    With `matched`, the query's terms that a paragraph has, or has a near one of, come along in the query's order. With `scope`,
    a column of both tables, a query searches the paragraphs of its own value only, by that part's statistics."""
    by = (scope,) if scope else ()
    toks = tokens(paras, by)
    asked = query_terms(queries, by)
    near = fuzzy_vocabulary(toks.select(*by, "term").distinct(), queries, by)
    wanted = asked.select("query_id", *by, F.col("term").alias("qterm"), "term", F.lit(None).cast("double").alias("similarity")).unionByName(near)
    # the terms' own partitioning is small; what matches is kept by paragraph from here on
    posts = postings(toks, wanted.select(*by, "term").distinct(), by)
    df = frequencies(posts, by).withColumnRenamed("term", "qterm")
    is_exact = F.col("similarity").isNull()
    per_term = posts.join(wanted, [*by, "term"]).groupBy("query_id", *by, "doc_id", "paragraph_index", "qterm").agg(F.max("len").alias("len"), F.max(F.when(is_exact, F.col("tf"))).alias("tf"), F.max("similarity").alias("s"))
    known = per_term.join(df, [*by, "qterm"], "left")
    scored = known.join(corpus_stats(paras, by), list(by)) if by else known.crossJoin(F.broadcast(corpus_stats(paras)))  # one row
    found = [F.collect_list("qterm").alias("found")] if matched else []
    both = scored.groupBy("query_id", "doc_id", "paragraph_index").agg(
        F.coalesce(F.sum(weight()), F.lit(0.0)).alias("bm25"), F.count("tf").alias("exact"), F.coalesce(F.sum(F.when(F.col("tf").isNull(), F.col("s"))), F.lit(0.0)).alias("fuzzy"), *found
    )
    shape = queries.select("query_id", T.lexical(F.col("query")).alias("q")).join(asked.groupBy("query_id").agg(F.count("*").alias("size")), "query_id")
    joined = both.join(shape, "query_id").join(paras.select("doc_id", "paragraph_index", T.lexical(F.col("text")).alias("t")), ["doc_id", "paragraph_index"])
    signal = F.col("exact") + config.FUZZY_WEIGHT * F.col("fuzzy")
    least = F.when(F.col("size") >= 6, 2.3).when(F.col("size") >= 4, 1.9).when(F.col("size") >= 3, 1.4).otherwise(0.8)
    kept = joined.withColumn("phrase", F.when((F.length("q") >= 6) & F.contains("t", "q"), 1).otherwise(0)).where((signal >= least) | (F.col("phrase") == 1))
    cover = signal / F.col("size")
    score = F.col("bm25") * (0.4 + cover) + F.col("phrase") + 4 * cover + 1.2 * F.col("fuzzy") + 0.6 * T.dice(T.ngrams(F.col("q")), T.ngrams(F.col("t")))
    in_order = [F.filter(F.array_distinct(T.terms(F.col("q"))), lambda t: F.array_contains("found", t)).alias("matched")] if matched else []
    return kept.select("query_id", "doc_id", "paragraph_index", T.half_up(score, 6).alias("score"), *in_order)


#: Paragraphs of a block.
BLOCK = 40_000
SIDE = ["kind", "query_id", "name", "other", "x"]


def in_blocks(paras: DataFrame, sizes: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Paragraphs (by..., block, doc_id, paragraph_index, t) dealt to blocks of about BLOCK, t being their plain text, and the blocks there
    are (by..., block). sizes (by..., n): a row for each value of `by`, one if there is none, so that they are broadcast."""
    sizes = sizes.select(*by, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    lines = paras.where("doc_id IS NOT NULL").select(*by, "doc_id", "paragraph_index", T.lexical(F.col("text")).alias("t"))
    joined = lines.join(F.broadcast(sizes), list(by)) if by else lines.crossJoin(F.broadcast(sizes))
    dealt = joined.withColumn("block", F.pmod(F.xxhash64("doc_id", "paragraph_index"), F.col("blocks")).cast("int")).drop("blocks")
    return dealt, sizes.select(*by, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))


def words(t: str) -> list[str]:
    """The terms of a plain text, as functions.text has them."""
    return [x for x in t.split(" ") if len(x) > 1]


def _grams(t: str) -> set[str]:
    return {t[i : i + config.NGRAM] for i in range(max(len(t) - config.NGRAM, 0) + 1)} if t else set()


class _Block:
    """The postings of a block's paragraphs by the terms that its queries want, and the scores of a query."""

    def __init__(self, texts: list[str], weights: dict[str, float], near: dict[str, list], avgdl: float):
        self.texts, self.weights, self.near, self.n = texts, weights, near, len(texts)
        self.ids = {t: i for i, t in enumerate({*weights, *(t for ts in near.values() for t, _ in ts)})}
        ids, lens, counts, terms = self.ids, [], [], []
        for t in texts:
            own = words(t)
            hit = [ids[x] for x in own if x in ids]
            lens.append(len(own))
            counts.append(len(hit))
            terms += hit
        at = np.array(terms, np.int64) * self.n + np.repeat(np.arange(self.n), counts)
        self.at, self.tf = np.unique(at, return_counts=True)
        self.norm = config.BM25_K1 * (1 - config.BM25_B + config.BM25_B * np.maximum(lens, 1) / avgdl)
        self.known, self.sizes = {}, None

    def postings(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.at, np.array([self.ids[term], self.ids[term] + 1]) * self.n) if term in self.ids else (0, 0)
        return self.at[a:b] - self.ids.get(term, 0) * self.n, self.tf[a:b]

    def parts(self, term: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Paragraphs with a term and their parts of BM25; those with near ones only, and the greatest similarity."""
        if term not in self.known:
            rows, tf = self.postings(term)
            best = np.zeros(self.n)
            for other, similarity in self.near.get(term, ()):
                among = self.postings(other)[0]
                best[among] = np.maximum(best[among], similarity)
            best[rows] = 0
            like = np.flatnonzero(best)
            self.known[term] = rows, self.weights.get(term, 0.0) * tf * (config.BM25_K1 + 1) / (tf + self.norm[rows]), like, best[like]
        return self.known[term]

    def dice(self, grams: set[str], row: int) -> float:
        """Overlap of n-grams; an n-gram is one of a text's if it stands in it."""
        t = self.texts[row]
        common = sum(len(g) == config.NGRAM and g in t for g in grams) if len(t) > config.NGRAM else t in grams
        return 2.0 * common / (len(grams) + int(self.sizes[row])) if grams or self.sizes[row] else 0.0

    def best(self, q: str, k: int, order: np.ndarray) -> list[tuple[float, int, list[str]]]:
        """The k best paragraphs for a query, as in full_score (ties: by `order`). Phrases and n-grams are looked at only where what they
        can add at most brings a paragraph among the k best."""
        terms = list(dict.fromkeys(words(q)))
        if not terms:
            return []
        bm, exact, fuzzy = np.zeros(self.n), np.zeros(self.n), np.zeros(self.n)
        for t in terms:
            rows, weight, like, similarity = self.parts(t)
            bm[rows] += weight
            exact[rows] += 1
            fuzzy[like] += similarity
        size, grams = len(terms), _grams(q)
        signal = exact + config.FUZZY_WEIGHT * fuzzy
        least = 2.3 if size >= 6 else 1.9 if size >= 4 else 1.4 if size >= 3 else 0.8
        base = bm * (0.4 + signal / size) + 4 * (signal / size) + 1.2 * fuzzy
        sure, phrased = signal >= least, (len(q) >= 6) & (exact >= size - 2) & (signal > 0)
        held = base[sure]
        bar = np.partition(held, len(held) - k)[len(held) - k] if len(held) > k else -np.inf
        rows = np.flatnonzero((sure | phrased) & (base + phrased + 0.6 + 1e-5 >= bar))
        if self.sizes is None and len(rows):
            self.sizes = np.array([len(_grams(t)) for t in self.texts])
        phrase = np.array([float(q in self.texts[r]) if p else 0.0 for r, p in zip(rows.tolist(), phrased[rows].tolist(), strict=True)])
        rows, phrase = rows[kept := sure[rows] | (phrase > 0)], phrase[kept]
        many = 0 if self.sizes is None else self.sizes[rows]
        most = base[rows] + phrase + 1.2 * np.minimum(many, len(grams)) / np.maximum(many + len(grams), 1)
        found, best = [], []
        for i in np.argsort(-most, kind="stable").tolist():
            if len(best) == k and most[i] + 1e-5 < best[0]:
                break
            row, cover = int(rows[i]), signal[rows[i]] / size
            score = bm[row] * (0.4 + cover) + phrase[i] + 4 * cover + 1.2 * fuzzy[row] + 0.6 * self.dice(grams, row)
            found.append((-float(np.floor(score * 1e6 + 0.5) / 1e6), int(order[row]), row))
            (heapq.heappushpop if len(best) == k else heapq.heappush)(best, -found[-1][0])
        has = lambda rows, row: (i := np.searchsorted(rows, row)) < len(rows) and rows[i] == row
        return [(-score, row, [t for t in terms if any(has(x, row) for x in self.parts(t)[::2])]) for score, _, row in sorted(found)[:k]]


def top_hits(paras: DataFrame, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """(query_id, doc_id, paragraph_index, score, matched, rank): the k best of full_score for each query. Paragraphs are shuffled once,
    as texts, to blocks of their scope; a block has all queries of its scope and keeps k a query, so that no row is made for a pair of a
    query and a paragraph. Statistics of terms come from sums by term."""
    by = (scope,) if scope else ()
    sizes, asked = corpus_stats(paras, by), query_terms(queries, by)
    vocabulary = term_stats(paras, by).select(*by, "term", "df").where("df > 0")  # both uses have these columns, and share a shuffle
    terms = asked.select(*by, F.col("term").alias("qterm")).distinct()
    df = terms.join(vocabulary.select(*by, F.col("term").alias("qterm"), "df"), [*by, "qterm"])
    df = df.join(F.broadcast(sizes), list(by)) if by else df.crossJoin(F.broadcast(sizes))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    row = lambda t, kind, query, name, other, x: t.select(*by, F.lit(kind).alias("kind"), query.cast("long").alias("query_id"), name.alias("name"), other.alias("other"), x.alias("x"))
    side = row(queries, 0, F.col("query_id"), T.lexical(F.col("query")), text, none).unionByName(row(df, 1, none, F.col("qterm"), text, idf))
    side = side.unionByName(row(fuzzy_terms(vocabulary.select(*by, F.when(F.col("df") > 0, F.col("term")).alias("term")), terms, by), 2, none, F.col("qterm"), F.col("term"), F.col("similarity"))).unionByName(row(sizes, 3, none, text, text, F.col("avgdl")))
    dealt, blocks = in_blocks(paras, sizes, by)
    side = side.join(F.broadcast(blocks), list(by)) if by else side.crossJoin(F.broadcast(blocks))
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("paragraph_index", pa.int32()), ("score", pa.float64()), ("matched", pa.list_(pa.string()))])

    def score(lines: pa.Table, given: pa.Table) -> pa.Table:
        weights, near, asked, avgdl = {}, {}, [], 1.0
        for kind, query, name, other, x in zip(*(given[c].to_pylist() for c in SIDE), strict=True):
            if kind == 0:
                asked.append((query, name))
            elif kind == 1:
                weights[name] = x
            elif kind == 2:
                near.setdefault(name, []).append((other, x))
            else:
                avgdl = x
        out = []
        if lines.num_rows and asked:
            docs, places = lines["doc_id"].to_numpy(), lines["paragraph_index"].to_numpy()
            order = np.empty(len(docs), np.int64)
            order[np.lexsort((places, docs))] = np.arange(len(docs))
            block = _Block(lines["t"].to_pylist(), weights, near, avgdl)
            out = [(query, int(docs[r]), int(places[r]), s, matched) for query, q in asked for s, r, matched in block.best(q, k, order)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 5, schema)], schema=schema)

    kind = queries.schema["query_id"].dataType
    hits = dealt.groupBy(*by, "block").cogroup(side.groupBy(*by, "block")).applyInArrow(score, "query_id long, doc_id long, paragraph_index int, score double, matched array<string>")
    return top(hits.withColumn("query_id", F.col("query_id").cast(kind)), k)
