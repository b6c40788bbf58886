"""What near duplicates write and move: no sets of hashes, no rows that cannot be linked, and no link lost by that."""

import os
import random

import numpy as np
import pyarrow as pa

from lexloom.llm import exact_near
from lexloom.llm.common import checkpoint_folder


def bytes_under(folder):
    return sum(os.path.getsize(f"{at}/{name}") for at, _, names in os.walk(folder.removeprefix("file:")) for name in names)


def test_writes_less_than_the_texts(spark, tmp_path):
    rows = [(i, " ".join(f"w{random.Random(i).randrange(10**9)}x{j}" for j in range(400))) for i in range(300)]
    rows += [(1000 + i, t + " more") for i, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = bytes_under(checkpoint_folder(spark))
    got = {r.doc_id: r.component_id for r in exact_near.near_classes(docs).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert bytes_under(checkpoint_folder(spark)) - before < 0.2 * sum(len(t) for _, t in rows)


def test_dropped_postings_lose_no_link():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = rng.choice(3000, rng.integers(3, 60), replace=False)
        for _ in range(4):
            sets.append(np.unique(np.append(base[rng.random(len(base)) > 0.06], rng.choice(3000, rng.integers(0, 3)))).astype(np.uint64))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = sorted((int(x), c, len(h), len(h) - k) for c, h in enumerate(sets) for k, x in enumerate(exact_near.prefix(h, *none)))
    linked = {(a, b) for a in range(len(sets)) for b in range(a) if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    for size in (1, 17, 10_000):
        table = pa.table([pa.array(c, k) for c, k in zip(zip(*(r for r in rows for _ in range(2))), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["token", "cid", "n", "left"])
        out = [r for b in exact_near._shared(iter(table.to_batches(max_chunksize=size))) for r in zip(b["token"].to_pylist(), b["cid"].to_pylist())]
        assert len(out) == len(set(out))
        by = {}
        for t, c in out:
            by.setdefault(t, []).append(c)
        met = {(max(a, b), min(a, b)) for g in by.values() for a in g for b in g if a != b}
        assert len(linked) > 50 and linked <= met
    several = {r[0] for r in rows if sum(r[0] == s[0] for s in rows) > 1}
    assert len(out) < 0.8 * sum(r[0] in several for r in rows)
