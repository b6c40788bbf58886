"""The training-data operators against brute force on small rows: nulls, empty and repeated texts, ties, extra columns."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash

from lexloom.llm import chat_format, html_extract, license_scan, maxscore_topk, pattern_packing, pii, quality_rules, queries, simhash_dedup, source_mixing, suffix_dedup

TEXTS = ["the quick brown fox jumps over the lazy dog " * 3, "the quick brown fox jumps over the lazy dog " * 3, None, "", "Licensed under the MIT License.\nmail a.1@x.example.com or +1 (017) 555-7713", "x" * 400, "ä ö \n\n ü\t", "Released under the Apache License, Version 2.0"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], f"src{i % 2}" if i % 4 else None, len(t or ""), "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank string")


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def test_chat_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("system", "be kind"), ("user", "hi [x] <b>"), ("assistant", "</s>\n[user]\\l"), ("user", None), (None, "w " * 900), ("assistant", "done"), ("assistant", "")])]
    rows += [(None, 0, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df, budget=64, history_tokens=16)).collect()}
    for key in (1, None):
        own = [(r or "", t or "") for c, _, r, t in rows if c == key]
        assert [(t.role, t.text) for t in out[key].turns] == own
        assert out[key].loss_text == "".join(t for r, t in own if r == "assistant")
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_packing_places_every_piece(spark, docs):
    rows = pattern_packing.packed_report(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    assert {r.doc_id for r in rows} == set(range(len(TEXTS)))
    lengths = collections.Counter(np.random.default_rng(1).integers(1, 4097, 3000).tolist())
    plan = pattern_packing.plan(lengths)
    assert sum((collections.Counter({n: k * c for n, k in s.items()}) for c, s in plan), collections.Counter()) == lengths
    assert all(sum(n * k for n, k in s.items()) <= 4096 for _, s in plan)


def test_html_keeps_the_article():
    model = html_extract.train([])
    page = "<nav>menu</nav><main><h1>T &amp; U</h1><p>One  two\nthree.<p>Four.</main><aside>side</aside><script>var a='</p>'</script><footer>foot</footer>"
    assert html_extract.main_texts([page, None, "", page], model) == ["T & U\nOne two three.\nFour.", "", "", "T & U\nOne two three.\nFour."]


@pytest.mark.parametrize("inside, want", [
    ('<p>One.</p><svg/><p>Two.</p>', "One.\nTwo."), ('<p>One <math/> more.</p><p>Two.</p>', "One more.\nTwo."), ('<p>One.</p><svg viewBox="0 0 1 1"><svg><text>in</text></svg><text>out</text></svg><p>Two.</p>', "One.\nTwo."),
    ('<p>One.</p><svg><path d="M0"><p>Two.</p>', "One.\nTwo."), ('<p>One.</p><datalist><option>a<option>b</datalist><p>Two.</p>', "One.\nTwo."), ('<p>One.</p><select><option>a<option>b</select><p>Two.</p>', "One.\nTwo."),
    ('<p>One <button>Copy</button> more.</p><p>Two.</p>', "One more.\nTwo."), ('<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>', "So x=2 holds."), ('<p>One.</p><template><p>t</p></template><p>Two.</p>', "One.\nTwo."),
    ('<p>One.</p><button>Go<p>Two.</p><button>More</button><p>Three.</p>', "One.\nGo\nTwo.\nThree."),
])
def test_html_drops_no_text_behind_foreign_elements(inside, want):
    page = f"<body><nav>menu</nav><article>{inside}</article><footer>foot</footer></body>"
    for model in (html_extract.train([]), html_extract.train([html_extract.parse("<nav>a</nav><article><p>One text.</p><p>Two.</p></article><footer>b</footer>")] * 20)):
        assert html_extract.main_texts([page], model) == [want]


def test_marginals_equal_enumeration():
    page = html_extract.parse("<article><p>one.</p><div class=ad>two</div></article><p>three</p>")
    batch = html_extract.Batch([page])
    got, _ = batch.marginals(html_extract.PRIOR, html_extract.PRIOR_EDGES)
    n, own = len(page.parent), batch.x @ html_extract.PRIOR
    total = np.zeros(n)
    every = 0.0
    for bits in range(2**n):
        y = [bits >> i & 1 for i in range(n)]
        p = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(html_extract.PRIOR_EDGES[batch.is_text[i], y[page.parent[i]], y[i]] for i in range(1, n)))
        total, every = total + p * np.array(y), every + p
    assert np.allclose(got, total / every, atol=1e-6)


def test_quality_counts(spark, docs):
    labels = spark.createDataFrame([(0, 1), (0, None), (99, 0)], "doc_id long, quality int")
    for r in quality_rules.quality_report(docs, labels).collect():
        w = words(TEXTS[r.doc_id])
        seen = collections.defaultdict(list)
        for i in range(len(w) - 2):
            seen[tuple(w[i : i + 3])].append(i)
        covered = {i + d for at in seen.values() if len(at) > 1 for i in at for d in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_repeats_by_brute_force(spark):
    texts = ["abc " * 30, "abc " * 30, None, "", "é" * 60, "é" * 40, "x" * 49, "q" + "abc " * 20 + "z", "abc " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for r in suffix_dedup.repeats_report(df).collect():
        b = (texts[r.doc_id] or "").encode()
        gone = {q for p in range(len(b) - 49) if first[b[p : p + 50]] < r.doc_id for q in range(p, p + 50)}
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), len(gone), hashlib.sha256(kept).hexdigest())


def test_repeats_of_a_passage_that_a_document_holds_twice(spark):
    rng = np.random.default_rng(8)
    made = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    texts = {}
    for i in range(0, 120, 3):
        passage, around = made(50 + i % 21), (made(80), made(80))
        twice = around[0] + passage + around[1]
        texts[i] = made(70) + passage + made(70)
        texts[i + 1] = twice + made(60) + twice
        texts[i + 2] = made(30) + twice + made(60) + twice + twice
    rows = [*texts.items(), (1, texts[1]), (1, made(40) + texts[1])]  # repeated rows, and another text of the same doc_id
    first = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], i))
    want = []
    for i, t in rows:
        gone = {q for p in range(len(t) - 49) if first[t[p : p + 50]] < i for q in range(p, p + 50)}
        want.append((i, len(t), len(gone), hashlib.sha256("".join(x for q, x in enumerate(t) if q not in gone).encode()).hexdigest()))
    got = suffix_dedup.repeats_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


def test_mixture_stays_in_budget(spark, docs):
    rows = source_mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    assert sum(r.n_tokens * r.copies for r in rows) <= 0.9 * sum(r.n_tokens for r in rows)
    assert source_mixing.mixture(docs).columns == docs.columns
    assert source_mixing.mix(docs.limit(0)).count() == 0


def test_shares_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0, 90.0), ("b", 1.0, 100.0, 90.0), ("c", 2.0, 100.0, 90.0)], "n string, weight double, capacity double, given double")
    from pyspark.sql import functions as F

    got = {r.n: round(r.budget, 6) for r in source_mixing.share(df, [F.lit(0)]).collect()}
    assert got == {"a": 10.0, "b": round(80 / 3, 6), "c": round(160 / 3, 6)}


def test_licenses(docs):
    rows = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert (rows[4].base_labels, rows[4].n_base, rows[4].first_word) == ("mit", 1, 3)
    assert rows[7].labels == "apache,apache-2.0" and rows[2].n_words == 0 and rows[3].labels == ""
    assert len(license_scan.rules()) >= 200


def examples(pattern):
    """Texts that the expression matches: each alternative once, each repeat as few times as it may be."""
    from re import _parser as parser

    def of(items):
        out = [""]
        for op, x in items:
            if op is parser.LITERAL:
                more = [chr(x)]
            elif op is parser.IN:
                more = [chr(x[0][1] if x[0][0] is parser.LITERAL else x[0][1][0])]
            elif op is parser.BRANCH:
                more = [y for branch in x[1] for y in of(branch)]
            elif op is parser.SUBPATTERN:
                more = of(x[3])
            elif op is parser.MAX_REPEAT:
                more = [y * x[0] for y in of(x[2])] if x[0] else [""]
            else:
                assert op is parser.ASSERT_NOT
                more = [""]
            out = list(dict.fromkeys(a + b for a in out for b in more))
        return out

    return of(parser.parse(pattern.pattern.decode()))


def test_every_signature_passes_the_prefilter():
    signatures = license_scan.rules()
    for rule in signatures:
        for text in examples(rule[0]):
            assert rule[0].search(f" {text} ".encode()), text
            found = license_scan.scan(text, signatures)
            assert found[5] and found[6] > 0, (rule[1], text)
    assert license_scan.scan("All rights reserved.", signatures)[4:] == ("", "proprietary", 0.5)
    assert license_scan.scan("Distributed under the terms of the MPL 2.0", signatures)[5] == "mpl-2.0"


def test_personal_data(docs, spark):
    rows = {r.doc_id: r for r in pii.span_report(docs).collect()}
    assert (rows[4].n_email, rows[4].n_phone, rows[2].spans) == (1, 1, "")
    assert "<email>" in pii.redact(docs).where("doc_id = 4").first().text


def test_simhash_by_brute_force(docs):
    rows = {r.doc_id: r for r in simhash_dedup.simhash_report(docs).collect()}
    fps = {}
    for i, t in enumerate(TEXTS):
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 3]), 42) for j in range(max(1, len(w) - 2))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert rows[i].fingerprint == f"{fps[i]:016x}"
    assert rows[1].component_id == 0 and rows[3].component_id == rows[2].component_id == 2


def connected(n, pairs):
    """The least number of each one's component."""
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label
    return label


def test_bucket_links_equal_all_pairs():
    rng = np.random.default_rng(3)
    codes = np.unique(np.concatenate([rng.integers(0, 2**63, 20, dtype=np.uint64)[rng.integers(0, 20, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))]))[:, None]
    pairs = simhash_dedup.Bucket(codes, 2).spanning()
    assert (np.bitwise_count(codes[pairs[:, 0], 0] ^ codes[pairs[:, 1], 0]) <= 2).all()
    group = np.array(connected(len(codes), pairs))
    far = np.bitwise_count(codes[:, None, 0] ^ codes[None, :, 0]) <= 2
    label = np.arange(len(codes))
    for _ in range(len(codes)):
        new = np.array([label[far[i]].min() for i in range(len(codes))])
        if (new == label).all():
            break
        label = new
    assert len(set(zip(group, label))) == len(set(group)) == len(set(label))


def test_bit_counts():
    rows = np.random.default_rng(4).integers(0, 2**63, (1000, 3), dtype=np.uint64)
    assert not simhash_dedup.bit_counts(rows[:0]).any()
    for n in (1, 2, 3, 24, 25, 1000):
        want = np.unpackbits(rows[:n].astype(">u8").view(np.uint8).reshape(n, -1), axis=1).sum(axis=0)
        assert (simhash_dedup.bit_counts(rows[:n]) == want).all()


def test_one_of_near_copies_stays(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(12):
        base = rng.choice(vocabulary, 300).tolist()
        rows.append((10 * group, " ".join(base)))
        for k in range(1, 5):  # one to four words changed: similarities from 0.97 down to 0.87
            w = list(base)
            for at in rng.choice(np.arange(10, 290), k, replace=False):
                w[at] = "new"
            rows.append((10 * group + k, " ".join(w)))
        rows.append((10 * group + 9, " ".join(base[:150] + rng.choice(vocabulary, 150).tolist())))  # half of it shared
    rows += [(None, "no id"), (None, "no id"), (500, None), (501, ""), (500, None)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string")
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted([10 * g + d for g in range(12) for d in (0, 9)] + [500]) and ids.count(None) == 2
    assert simhash_dedup.keep_one(df.limit(0)).count() == 0


def test_near_duplicates_by_brute_force(spark):
    from lexloom.llm import exact_near

    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two")]
    for group in range(25):  # similarities around 0.8; a group of over SMALL copies
        base = rng.choice(vocabulary, 60 + 4 * group).tolist()
        for k in range(48 if group == 3 else 6):
            w = list(base)
            for at in rng.choice(len(w), rng.integers(1, 4), replace=False):
                w[at] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    sets = {i: {tuple(w[j : j + 5]) for w in [words((t or "").lower())] if w for j in range(max(1, len(w) - 4))} for i, t in rows}
    label = {i: i for i, _ in rows}
    alike = [(i, j) for i in label for j in label if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in rows:
        before = dict(label)
        for i, j in alike:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    got = {r.doc_id: r.component_id for r in exact_near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == label
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == sorted(set(label.values()))


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_links_over_batches(batch):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    keys = sorted(f"{k:02d}" for k in np.concatenate([rng.integers(0, 40, 150), np.full(100, 50)]))
    codes = rng.integers(0, 2**63, 8, dtype=np.uint64)[rng.integers(0, 8, 250)] ^ (np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64))
    rows = pa.table({"key": keys, "fp": pa.array([int(c).to_bytes(8, "big") for c in codes], pa.binary()), "rep": np.arange(250)})
    got = {tuple(x) for b in simhash_dedup._links(2)(iter(rows.to_batches(max_chunksize=batch))) for x in zip(b["a"].to_pylist(), b["b"].to_pylist())}
    near = {(i, j) for i in range(250) for j in range(250) if keys[i] == keys[j] and int(codes[i] ^ codes[j]).bit_count() <= 2}
    assert got <= near and connected(250, got) == connected(250, near)


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 8)).astype("float32")
    v[7] = v[8] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [float("nan")] * 8), (502, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, maxscore_topk.top_k(df, shard=30, query_block=1).collect()))
    q = np.floor(256 * v.astype(float)).astype(int)
    want = []
    for i in (0, 50, 100):
        s = q @ q[i]
        want += [(i, n + 1, j, int(s[j])) for n, j in enumerate([j for j in sorted(range(120), key=lambda j: (-s[j], j)) if j != i][:5])]
    assert got == want


def test_candidates_of_a_shingle_are_all_pairs_of_unlike_labels():
    import pyarrow as pa

    from lexloom.llm import exact_near

    rng = np.random.default_rng(12)
    sizes = [1, 2, 5, 32, 33, 60]
    token = np.repeat(np.arange(len(sizes)), sizes)
    n = len(token)
    base = [np.sort(rng.integers(0, 2**63, 40, dtype=np.uint64)) for _ in sizes]
    sets = [np.unique(np.concatenate([base[t][rng.permutation(40)[: rng.integers(30, 41)]], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)])) for t in token]
    cid, label = np.arange(n), rng.integers(0, 9, n)
    high = np.where(token == 5, 1, 0)  # the last group is of two blocks
    block = np.where(token == 5, cid % 2, 0)
    rows = pa.table({"token": token, "low": np.zeros(n, int), "high": high, "block": block, "cid": cid, "n": [len(x) for x in sets], "sketch": [exact_near.sketch(x) for x in sets], "label": label})
    got = {(a, b) for batch in exact_near._pairs(iter(rows.to_batches(max_chunksize=17))) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())}
    allowed = {(i, j) for i in range(n) for j in range(i + 1, n) if token[i] == token[j] and label[i] != label[j] and (token[i] != 5 or block[i] != block[j])}
    linked = {(i, j) for i, j in allowed if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert linked and linked <= got <= allowed


def test_components_of_a_hot_node(spark):
    from lexloom.llm import components

    rows = [(0, i) for i in range(1, 60)] + [(100, 59), (200, 201), (None, 3), (7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(60), 100]}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def quality_reference(t):
    """Counts, base verdict and rule values of a text, in plain Python."""
    w = words(t)
    seen = collections.defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    lines = [x for x in (t or "").split("\n") if words(x)]
    n, chars, repeats = len(w), sum(map(len, w)), len({i + d for at in seen.values() if len(at) > 1 for i in at for d in range(3)})
    symbols, dup = len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines))
    values = {"symbols": symbols / max(chars, 1), "dup_lines": dup / max(len(lines), 1), "repeats": repeats / max(n, 1), "long_words": chars / max(n, 1), "short_words": -chars / max(n, 1)}
    return (n, chars, symbols, dup, repeats, n < 50 or 100 * repeats > 50 * n), values


def test_quality_verdicts_by_brute_force(spark):
    import math

    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect():
        labels[r.doc_id] = max(r.quality, labels.get(r.doc_id, 0))
    steps = quality_rules.steps()
    made = {i: quality_reference(r.text) for i, r in rows.items()}
    first = {i: next((n for n, (rule, cut) in enumerate(steps, 1) if v[rule] > cut), len(steps) + 1) for i, (_, v) in made.items()}
    strata = collections.defaultdict(list)
    for i, q in labels.items():
        if i in rows and q == 1 and not made[i][0][-1]:
            strata[rows[i].lang].append(first[i])
    allowed = {}
    for lang, firsts in strata.items():
        n, allowed[lang] = len(firsts), 0
        for step in range(1, len(steps) + 1):
            k = sum(x <= step for x in firsts)
            if sum(math.comb(n, j) * 0.1**j * 0.9 ** (n - j) for j in range(k + 1)) > 0.05 / len(strata) or k > 0.1 * n:
                break
            allowed[lang] = step
    assert sorted(map(bool, allowed.values())) == [False, False, True, True]  # two languages have too few labels here
    got = quality_rules.quality_report(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), risk=0.1).collect()
    assert len(got) == len(rows)
    for r in got:
        counts = made[r.doc_id][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts
        assert r.kept == (not counts[-1] and first[r.doc_id] > allowed.get(rows[r.doc_id].lang, 0)), r.doc_id


def test_binomial_bound_is_exact(spark):
    import math

    cases = [(k, n, risk, error) for n in (1, 50, 90, 400) for k in (0, 1, 3, 10) if k <= n for risk in (0.02, 0.1) for error in (0.05, 0.001)]
    for k, n, risk, error in cases:
        got = spark.range(1).select(quality_rules.admissible(f"{k}L", f"{n}L", risk, f"{error}D")).first()[0]
        assert got == (k <= n * risk and sum(math.comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1)) <= error), (k, n, risk, error)


def test_quality_of_empty_tables_and_clashing_names(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_report(docs.limit(0), labels).count() == 0
    clash = docs.selectExpr("*", "1 as allowed", "'x' as stratum", "2 as quality", "3 as cut_symbols")
    assert quality_rules.keep_good(clash.unionAll(clash), labels).columns == clash.columns
    assert quality_rules.quality_report(docs.unionAll(docs), labels).count() == 2 * len(TEXTS)


def spans_reference(t):
    """The base spans of a text by the four patterns as they are stated, in plain Python."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda d: sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, good in kinds for m in re.finditer(p, t or "") if good(m[0])]


def test_base_spans_by_brute_force(spark):
    rng = np.random.default_rng(11)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "+1 (017) 555-7713", "4539 1488 0343 6467", "x", "é", "\U0001F600", " ", "-", "_", "7", "0009", "\n", "a.b+c@d-e.f.g", "4539148803436467", "+", "(", ")"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 60))) for _ in range(400)]
    texts += [None, "", "1.2.3.4 " * 700, "7 x " * 600, "a@b.c_d@e.f" * 3, "1.2.3.4.5.6.7.8", "0000000000001.2.3.4"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.span_report(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = spans_reference(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in ("email", "ip", "card", "phone")], texts[r.doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert not want or set(joined.split(",")) <= set(r.spans.split(","))
    assert pii.span_report(df.limit(0)).count() == 0


def test_personal_data_of_long_runs_is_linear(spark):
    import time

    pii.train(spark)
    df = spark.createDataFrame([(1, "a@ " + "b" * 1_000_000), (2, "1" * 1_000_000), (3, "a.b@ " * 50_000), (4, "+1 5" * 60_000), (5, "12 x " * 50_000)], "doc_id long, text string").repartition(5)
    began = time.time()
    assert sum(r.n_email + r.n_ip for r in pii.span_report(df).collect()) == 0
    assert time.time() - began < 60


def test_secrets_need_no_digit_and_reach_beyond_a_card(spark):
    text = 'token = "QmFzZUxpa2VTZWNyZXRXaXRoTm9EaWdpdHNJblN0cmluZw"'
    held = 'secret="9f86d081884c7d659a2feaa04539148803436467c55ad015a3bf4f1b2b0b822c"'
    df = spark.createDataFrame([(1, text), (2, held)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert "QmFz" not in clean[1] and "9f86" not in clean[2] and "b822c" not in clean[2]


@pytest.fixture(scope="module")
def page_model(spark):
    return html_extract.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("inside, want", [
    ("<p data-x=don't>Hello one.</p><p>it's two.</p><p>three</p>", "Hello one.\nit's two.\nthree"), ('<p title="a > b">One.</p><p>Two.</p>', "One.\nTwo."), ('<p>One.</p><a b="x>Two.</a><p>Three.</p>', "One.\nTwo.\nThree."),
    ("<p>Before.</p><table><tr><td>c1</td><td>c2</td></tr></table>", "Before.\nc1\nc2"), ("<header><h1>Headline</h1></header><p>Text of it.</p>", "Headline\nText of it."), ('<p class="tabs">A paragraph.</p>', "A paragraph."),
    ('<div class="share-price">The price rose.</div>', "The price rose."), ("<p>a &amp;amp; b <![CDATA[x &amp; <y>]]></p>", "a &amp; b x &amp; <y>"), ("<ul><li>one<li>two</ul><p>1 < 2 and 3 > 2</p>", "one\ntwo\n1 < 2 and 3 > 2"),
    ('<p>One.</p><div class="share-buttons"><a href="#">Tweet</a></div><div class="comments"><p>First! I was here before you all, really.</p></div><aside><p>More of this.</p></aside><p>Two.</p>', "One.\nTwo."),
    ("<h2>A</h2><dl><dt>term</dt><dd>sense</dd></dl><figure><img src=x><figcaption>shown</figcaption></figure>", "A\nterm\nsense\nshown"),
])
def test_html_keeps_all_of_an_article(page_model, inside, want):
    page = f"<body><header><h1>Site</h1></header><nav class='menu'><a href=/>menu</a></nav><article>{inside}</article><div class='cookie-banner'>We use cookies.</div><footer>foot</footer></body>"
    assert html_extract.main_texts([page], page_model) == [want]


def test_html_of_a_whole_table_by_its_articles(spark, page_model):
    """The synthetic pages' articles hold headings and paragraphs only, so a regular expression says what their text is."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
        want[r.page_id] = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in b else "", b)).split()) for b in (re.sub(r"<br>", " ", b) for b in blocks)) if x)
    got = {r.page_id: r for r in html_extract.extract(pages, page_model).collect()}
    assert got.keys() == want.keys()
    assert [i for i in want if got[i].text != want[i]] == [] and all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(pages.limit(0), page_model).count() == 0
    odd = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (2, "u", "", "y")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(odd).collect()) == [(1, "", 0), (1, "", 0), (2, "", 0)]


@pytest.mark.parametrize("piece", ["<a b='", "<a b='>'", "<div>", "<b>", "<svg>", "<!", "<!-- ", "<p>x<b>", "<button>", "</i>", "&amp;", "<td>", "<li><ul>", "<![CDATA["])
def test_html_costs_what_its_length_does(piece):
    import time

    source = "<article><p>Start.</p>" + piece * (500_000 // len(piece)) + "end"
    began = time.time()
    html_extract.main_texts([source], html_extract.train([]))
    assert time.time() - began < 20, piece


def licenses_reference(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    places = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_license_bases_by_brute_force(spark):
    rng = np.random.default_rng(13)
    parts = ["MIT", "license", "mit License", "APACHE-license", "general", "public", "License", "gnu", "2.0", "é", "\u2028", "x", "under", "the", "\n", "general public license"]
    texts = [None, "", "...", "\U0001F600 mit license", *("".join(y + " " * int(rng.integers(0, 3)) for y in rng.choice(parts, rng.integers(0, 40))) for _ in range(400))]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = license_scan.scan_licenses(spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(3)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licenses_reference(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suppressed_licenses_by_all_pairs():
    signatures = license_scan.rules()
    rng = np.random.default_rng(14)
    parts = ["released under the terms of the", "apache", "license", "version 2 0", "mit", "gnu general public license", "spdx license identifier mit", "cc by 4 0", "x", "copyright 2020", "all rights reserved", "licensed under"]
    for _ in range(300):
        text = " ".join(rng.choice(parts, rng.integers(1, 15)))
        found, doubt = [], 1.0
        for pattern, label, _, trust, _ in signatures:
            for m in pattern.finditer(f" {text} ".encode(), 1):
                if not any(a <= m.start() and m.end() <= b for a, b, _ in found):
                    found.append((*m.span(), label))
                    doubt *= 1 - trust
        got, base = license_scan.scan(text, signatures), licenses_reference(text)[4]
        assert set(filter(None, got[5].split(","))) == {x for *_, x in found} | set(filter(None, base.split(","))), text
        assert base or abs(got[6] - (1 - doubt)) < 1e-6


def test_licenses_of_long_texts_are_linear():
    import time

    signatures, began = license_scan.rules(), time.time()
    got = license_scan.scan("mit license x " * 75_000, signatures)
    assert got[:4] == (225_000, 75_000, 0, 224_997) and time.time() - began < 10


def test_maxscore_by_brute_force():
    rng = np.random.default_rng(21)
    for trial in range(60):
        n, d = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        cand = np.floor(rng.normal(size=(n, d)) * rng.choice([1, 40, 256], d) * (rng.random((n, d)) < rng.random()))
        queries = np.concatenate([np.floor(rng.normal(size=(4, d)) * 100), np.zeros((1, d)), cand[:1]])
        ids = np.sort(rng.choice(1000, n, replace=False))
        asked = np.array([-1, -2, -3, -4, -5, ids[0]])
        got = list(maxscore_topk.best_in_shard(queries, ids, asked, cand, 5))
        want = [(int(i), int(ids[j]), int(cand[j] @ q)) for q, i in zip(queries, asked) for j in sorted(range(n), key=lambda j: (-(cand[j] @ q), ids[j])) if ids[j] != i]
        by = {i: [w for w in want if w[0] == i][:5] for i in asked.tolist()}
        assert got == [w for i in asked.tolist() for w in by[i]], trial
    big = np.array([[2.0**40, 3.0], [2.0**40, 4.0]])  # beyond what floats hold
    assert list(maxscore_topk.best_in_shard(big[:1] * 2.0**20, np.array([5, 6]), np.array([9]), big, 2)) == [(9, 6, 2**100 + 12 * 2**20), (9, 5, 2**100 + 9 * 2**20)]


def test_topk_of_few_and_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, score int"
    assert maxscore_topk.top_k(spark.createDataFrame([], schema)).count() == 0
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [3.0, -1.0], 1), (3, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)]
    got = sorted(map(tuple, maxscore_topk.top_k(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(0, 1, 3, 5 * 65536), (0, 2, 2, 65536)]


def test_mixture_by_target_weights(spark):
    rows = [(i, "w " * 10, "en" if i % 2 else "de", f"src{i % 4}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    levels = {"language": "lang", "origin": "source"}
    weights = spark.createDataFrame([("en", 3.0), ("de", 1.0), ("en/src1", 0.0), ("en/src3", 2.0), ("fr", 5.0)], "path string, weight double")
    got = {(r.language, r.origin): r.t for r in source_mixing.mix(df, share_of_tokens=0.5, levels=levels, weights=weights, epochs=4).groupBy("language", "origin").agg({"*": "count"}).join(
        source_mixing.mix(df, share_of_tokens=0.5, levels=levels, weights=weights, epochs=4).selectExpr("language", "origin", "n_tokens * copies as t").groupBy("language", "origin").sum("t").withColumnRenamed("sum(t)", "t"), ["language", "origin"]).collect()}
    # 20,000 tokens: 15,000 of en, all of them src3; 5,000 of de, half of each source
    assert got[("en", "src1")] == 0 and abs(got[("en", "src3")] - 15_000) <= 10 and abs(got[("de", "src0")] - 2500) <= 10 and abs(got[("de", "src2")] - 2500) <= 10


def mixed_reference(rows, total_share, exponent, epochs, seed, said=None):
    """Copies by doc_id of distinct rows (doc_id, text, lang, source): budgets by bisection on the rate, in plain Python. `said` has
    weights by path; what it leaves out beside what it names, or gives no weight, is not there at all."""
    name = lambda r: (f"d{int((re.search('[0-9]+', r[3] or '') or ['0'])[0]) % 4}", r[2] or "", r[3] or "")
    n = {r[0]: len(words(r[1])) for r in rows}
    said, leaves = said or {}, collections.Counter()
    for r in rows:
        leaves[name(r)] += n[r[0]]
    every = sum(leaves.values())
    for depth in range(1, 4):
        there = {x[:depth] for x, t in leaves.items() if t}
        named = {x[:-1] for x in there if "/".join(x) in said}
        leaves = {x: t for x, t in leaves.items() if x[: depth - 1] not in named or said.get("/".join(x[:depth]), 0) > 0}
    size = collections.Counter()
    for x, t in leaves.items():
        for depth in range(4):
            size[x[:depth]] += t
    weigh = lambda k: said.get("/".join(k)) or size[k] ** exponent
    budget = {(): min(total_share * every, epochs * size[()])}
    for depth in range(1, 4):
        for parent in [x for x in size if len(x) == depth - 1 and size[x]]:
            kids = [x for x in size if len(x) == depth and x[:-1] == parent and size[x]]
            lo, hi = 0.0, 1e12
            for _ in range(200):
                rate = (lo + hi) / 2
                lo, hi = (rate, hi) if sum(min(epochs * size[k], rate * weigh(k)) for k in kids) < budget[parent] else (lo, rate)
            budget |= {k: min(epochs * size[k], hi * weigh(k)) for k in kids}
    copies = {}
    for leaf in {name(r) for r in rows}:
        own = [r[0] for r in rows if name(r) == leaf]
        full = int(budget.get(leaf, 0) / size[leaf] + 1e-9) if size[leaf] else 0
        rest, upto = budget.get(leaf, 0) - full * size[leaf], 0
        for i in sorted(own, key=lambda i: hashlib.md5(f"{seed}:{full + 1}:{i}".encode()).hexdigest()):
            upto += n[i]
            copies[i] = full + (size[leaf] > 0 and upto <= rest + 1e-6)
    return copies


@pytest.mark.parametrize("said", [{"d0": 3.0, "d1": 1.0, "d0/en": 1.0}, {"d0": 0.0, "d1": 2.0, "d2": 1.0, "d2/fr": 0.0}, {"d3/de": 5.0, "d3/es": 1.0, "d1/en/src1": 1.0}, {"d9": 1.0}, {"d0": 0.0, "d1": 0.0, "d2": 0.0, "d3": 0.0}])
def test_mixture_with_some_weights_by_brute_force(spark, said):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = spark.createDataFrame(list(said.items()), "path string, weight double")
    got = {r.doc_id: r.copies for r in source_mixing.mix(df, share_of_tokens=0.5, epochs=1.5, weights=weights).collect()}
    assert got == mixed_reference(rows, 0.5, 0.7, 1.5, 17, said)


def test_a_shortage_of_named_leaves_goes_to_siblings(spark):
    rows = [(0, "w " * 100, "en", "s0"), (1, "w " * 900, "de", "s0")] + [(10 + i, "w " * 10, "en", "s1") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = spark.createDataFrame([("d0", 3.0), ("d1", 1.0), ("d0/en", 1.0)], "path string, weight double")
    taken = source_mixing.mix(df, share_of_tokens=0.5, epochs=1.0, weights=weights).groupBy("domain").agg({"*": "count"}).count()
    got = {r.domain: r.t for r in source_mixing.mix(df, share_of_tokens=0.5, epochs=1.0, weights=weights).selectExpr("domain", "n_tokens * copies AS t").groupBy("domain").sum("t").withColumnRenamed("sum(t)", "t").collect()}
    assert taken == 2 and got == {"d0": 100, "d1": 900}


def test_mixture_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").collect()] + [(-1, None, None, None), (-2, "", "en", "zz"), (-3, "a b", None, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_tokens", __import__("pyspark").sql.functions.lit("clash"))
    got = {r.doc_id: r.copies for r in source_mixing.mix(df).collect()}
    assert got == mixed_reference(rows, 0.9, 0.7, 2.0, 17)


def test_pieces_are_the_tokenizers(spark):
    import zlib

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pattern_packing.tokenizer_path())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "long words here " * 4000), (-3, "another of the same id"), (-4, "İ \U0001F600 ﬁ <|end|> don't")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    made = pattern_packing.packed_report(df).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made) == want
    used = collections.Counter()
    for r in made:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and sorted(used) == list(range(len(used)))
    assert pattern_packing.packed_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    res = con.sql(queries.SQL[name])
    assert sorted(map(str, (tuple(r[c] for c in df.columns) for r in df.collect()))) == sorted(map(str, (tuple(r[res.columns.index(c)] for c in df.columns) for r in res.fetchall())))
