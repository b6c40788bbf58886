"""The best hits by blocks are those of the full score, and near terms are those of comparing all pairs."""

import random

import pytest

from pyspark.sql import functions as F

from lexloom.operators import hybrid, lexical


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 12))) for _ in range(60)]
    text = lambda most: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, most)))
    return [(f"s{i % 2}", i // 5, i % 5 + 1, text(30)) for i in range(n)], [(q, f"s{q % 2}", text(8)) for q in range(12)] + [(90, "s0", "!"), (91, "s1", "abcab"), (92, "none", "abc")]


@pytest.mark.parametrize("scope", [None, "source"])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_top_hits_are_those_of_the_full_score(spark, monkeypatch, scope, k):
    monkeypatch.setattr(lexical, "BLOCK", 70)
    rows, queries = made(3, 300)
    paras = spark.createDataFrame(rows, "source string, doc_id long, paragraph_index int, text string")
    asked = spark.createDataFrame(queries, "query_id int, source string, query string")
    asked = asked if scope else asked.drop("source")
    want = lexical.top(lexical.full_score(paras, asked, True, scope), k)
    got = lexical.top_hits(paras, asked, k, scope)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("scope", [None, "source"])
def test_nearest_paragraphs_are_those_of_all_pairs(spark, monkeypatch, scope):
    monkeypatch.setattr(lexical, "BLOCK", 70)
    rows, queries = made(4, 200)
    by, key = (scope,) if scope else (), ["doc_id", "paragraph_index"]
    paras = spark.createDataFrame(rows, "source string, doc_id long, paragraph_index int, text string")
    asked = spark.createDataFrame(queries, "query_id int, source string, query string")
    asked = asked if scope else asked.drop("source")
    want = hybrid.similar(hybrid.unit_vectors(hybrid.text_dims(paras, [*by, *key]), [*by, *key]), hybrid.query_vectors(asked, also=by), key, 9, by=by)
    got = hybrid.nearest_paragraphs(paras, asked, 9, scope)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_near_terms_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abç") for _ in range(rng.randrange(1, 13))) for _ in range(900)})
    v = spark.createDataFrame([(t,) for t in terms], "term string")
    q = spark.createDataFrame([(t,) for t in terms[::7]], "qterm string")
    d = F.levenshtein("term", "qterm")
    near = (d <= 2) & (1 - d / F.greatest(F.length("term"), F.length("qterm")) >= 0.72) & (F.length("term") > 2) & (F.length("qterm") > 2)
    want = v.crossJoin(q).where(near & (F.col("term") != F.col("qterm"))).select("qterm", "term")
    assert sorted(map(tuple, lexical.fuzzy_terms(v, q).select("qterm", "term").collect())) == sorted(map(tuple, want.collect()))


def test_hybrid_search_shuffles_no_row_for_a_token_or_dimension(spark):
    """The texts, and sums by term, are all that grows."""
    rows, queries = made(6, 2000)
    paras = spark.createDataFrame(rows, "source string, doc_id long, paragraph_index int, text string")
    plan = hybrid.hybrid_paragraphs(paras, spark.createDataFrame([(q, t) for q, _, t in queries], "query_id int, query string"), 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "dim" not in plan and "tf#" not in plan
