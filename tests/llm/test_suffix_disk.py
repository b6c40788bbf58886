"""What repeated passages write and move: short rows by run, no bytes of runs that can have no equal suffix, and no repeat lost by that."""

import random

import numpy as np

from lexloom.llm import suffix_dedup
from lexloom.llm.suffix_dedup import SPAN


def moved(texts, buckets):
    """Blobs of runs by key, and the ranges that are settled and open."""
    rows = np.concatenate([r for d, t in enumerate(texts) for r in [suffix_dedup.runs_of(t.encode())] if not r["doc"].fill(d)])
    docs = np.array([(d, 0) for d in range(len(texts))], suffix_dedup.DOC)
    blobs = list(suffix_dedup._dealt(docs, rows, suffix_dedup._key_bucket(rows["key"], buckets)))
    settled = [b for blob in blobs for b in suffix_dedup._settle_runs(buckets)(iter([suffix_dedup._batch([blob])]))]
    of = {kind: [x for b in settled for x, is_open in zip(b["blob"].to_pylist(), b["open"].to_pylist()) if is_open == kind] for kind in (False, True)}
    return rows, blobs, of


def words(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


def test_a_run_is_few_bytes_however_many_buckets():
    rng = random.Random(1)
    rows, blobs, _ = moved([words(rng, 4000) for _ in range(300)], 400)
    assert sum(len(b) for _, b in blobs) < 20 * len(rows)


def test_phrases_shorter_than_a_span_stay_closed():
    rng = random.Random(2)
    phrase = words(rng, 30)
    rows, _, of = moved([words(rng, 300) + phrase + words(rng, 300) for _ in range(200)], 1)
    opened = sum(len(suffix_dedup._unpack(b, suffix_dedup.RANGE)[1]) for b in of[True])
    assert len(np.unique(rows["key"])) < len(rows) - 150  # the phrase's runs share their keys
    assert opened < 40 and not of[False]


def brute(texts):
    first = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - SPAN + 1):
            first.setdefault(t[i : i + SPAN], d)
    out = []
    for d, t in enumerate(texts):
        gone = [False] * len(t)
        for i in range(len(t) - SPAN + 1):
            if first[t[i : i + SPAN]] < d:
                gone[i : i + SPAN] = [True] * SPAN
        out.append(sum(gone))
    return out


def test_spans_in_any_surroundings_are_found(spark):
    rng, texts = random.Random(3), []
    shared = [words(rng, n) for n in (SPAN, SPAN, SPAN + 1, 67, 90)] + ["ab" * 40, "x" * 70, words(rng, 17) * 5, (words(rng, 30) + "=" * 20) * 2]
    for _ in range(60):
        a, b = rng.sample(shared, 2)
        cut = rng.randrange(0, 8)
        texts.append(words(rng, rng.randrange(0, 60)) + a[cut:] + words(rng, rng.randrange(0, 40)) + b[: len(b) - cut] + words(rng, rng.randrange(0, 60)))
    got = suffix_dedup.repeats_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7))
    assert [r.n_removed for r in sorted(got.collect(), key=lambda r: r.doc_id)] == brute(texts)
