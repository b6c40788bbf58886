"""Nearest vectors, second lists and recall on odd tables, against their SQL; and that no query makes a row for each pair."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexloom.operators import vector
from lexloom.plans import registry
from test_queries import plain

NEAR = ("vec_topk", "semantic_confidence")
LISTED = ("rerank_fillup", "evidence_levels", "admin_score_merge", "rrf_hybrid")
RECALL = ("recall_mrr", "eval_means")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Negative ids, a label of one row, none, many rows in few classes, equal and nearly equal vectors, null components, wrong lengths."""
    rng, at = np.random.default_rng(4), tmp_path_factory.mktemp("odd")
    ids = [*range(-340, 900), *range(10_000, 10_000 + 1009 * 50, 1009), *range(200_000, 203_000, 50)]
    v = [None if i % 97 == 0 else list(map(float, rng.normal(size=63 if i % 89 == 0 else 64))) for i in ids]
    for i in range(0, len(ids), 5):
        v[i] = [0.25] * 63 + [0.25 + (i % 3) * 1e-7]
    for i in range(3, len(ids), 31):
        v[i] = [None, *v[i][1:]] if v[i] else None
    labels = [None if i % 53 == 0 else "alone" if i == 700 else f"l{i % 3}" for i in ids]
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "label": labels, "embedding": pa.array(v, pa.list_(pa.float32()))})
    pq.write_table(table, f"{at}/embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", NEAR + LISTED + RECALL)
def test_same_rows_as_sql_on_odd_vectors(spark, odd, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{odd}/embeddings.parquet'")
    df = registry.QUERIES[name](spark, odd)
    names = sorted(df.columns)
    res = con.sql(registry.SQL[name])
    at = [res.columns.index(c) for c in names]
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=str)


@pytest.mark.parametrize("name", LISTED + RECALL)
def test_no_row_for_each_pair_of_a_label(spark, tmp_path, name):
    n, rng = 2500, np.random.default_rng(5)
    pq.write_table(pa.table({"vec_id": pa.array(range(0, 100 * n, 100), pa.int64()), "label": ["one"] * n, "embedding": pa.array(list(rng.normal(size=(n, 64)).astype(np.float32)), pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    df = registry.QUERIES[name](spark, str(tmp_path))
    df.write.format("noop").mode("overwrite").save()
    assert df.count() > 0
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    df.collect()
    while plan:
        node = plan.pop()
        kind = node.getClass().getSimpleName()
        inner = {"AdaptiveSparkPlanExec": lambda: [node.executedPlan()], "ReusedExchangeExec": list}.get(kind) or ((lambda: [node.plan()]) if "QueryStage" in kind else lambda: [node.children().apply(i) for i in range(node.children().size())])
        plan += inner()
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
    assert most < n * n // 10


def test_best_pairs_by_brute_force(monkeypatch):
    monkeypatch.setattr(vector, "PAIRS", 700)
    rng = np.random.default_rng(6)
    v, q = rng.integers(-3, 4, (300, 8)).astype(float), rng.integers(-3, 4, (40, 8)).astype(float)
    v[5], ids, own = 0, np.arange(300), np.arange(40) * 7
    norm, qnorm = np.sqrt((v * v).sum(1)), np.sqrt((q * q).sum(1))
    for k in (1, 7, 299, 400):
        got = [(r, c, s) for part in vector.best_pairs(v, norm, q, qnorm, k, ids, own) for r, c, s in zip(*map(np.ndarray.tolist, part))]
        want = []
        for r in range(40):
            s = [(0.0 if not norm[c] * qnorm[r] else np.floor(v[c] @ q[r] / (norm[c] * qnorm[r]) * 1e6 + 0.5) / 1e6, c) for c in range(300) if c != own[r]]
            want += [(r, c, x) for x, c in sorted(s, key=lambda t: (-t[0], t[1]))[:k]]
        assert got == want
