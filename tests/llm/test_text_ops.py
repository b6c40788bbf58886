"""Cuts for filling in the middle, spelling variants and secrets, against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from lexloom.llm import fill_middle, secret_scan, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(2)


# --- fill in the middle


def plain_cut(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


CUTS = [(1, "abc"), (1, "abc"), (2, None), (3, ""), (4, "é" * 70_000), (5, "a<P>b"), (None, "no id"), (6, "<S"), (7, "x" * 300_000 + "\U0001f333"), *((i, f"«{i}» text <{i}> é\n" * (i % 7)) for i in range(10, 60))]


def test_cuts_equal_plain_slices(spark):
    made = fill_middle.fill_middle(docs_of(spark, CUTS)).collect()
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in made) == sorted((str(i), *plain_cut(i, t)) for i, t in CUTS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = fill_middle.fill_middle_report(docs_of(spark, CUTS)).collect()
    assert sorted((str(r.doc_id), r.output_sha256, r.restored_sha256) for r in got) == sorted((str(i), sha(plain_cut(i, t)[-1]), sha(t or "")) for i, t in CUTS)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_cuts_of_empty_tables_and_extra_columns(spark):
    assert fill_middle.fill_middle(docs_of(spark, [])).count() == 0
    extra = spark.createDataFrame([(1, "abc", "x", 5)], DOCS + ", output string, n int")
    assert fill_middle.fill_middle(extra).columns == ["doc_id", "n", "form", "prefix_units", "middle_units", "output"]


@pytest.mark.parametrize("unit", ["character", "word", "line"])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_chunks_find_every_unit(unit, size):
    text = "é one  two\nthree\n\n çfour five\x0b six ".encode()
    begins = {"character": [i for i in range(len(text)) if text[i] & 0xC0 != 0x80], "word": [m.start() for m in re.finditer(rb"[^ \t-\r]+", text)], "line": [0, *(m.end() for m in re.finditer(rb"\n(?=.)", text, re.S))]}[unit]
    chunks = fill_middle.Chunks(text, unit, size)
    assert chunks.n == len(begins) and [chunks.place(k) for k in range(1, len(begins))] == begins[1:] and chunks.place(len(begins)) == len(text)


# --- spelling variants


def plain_words(rows):
    c = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += len(w) >= 5
    return {w: n for w, n in c.items() if n >= 3}


def apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(v):
    near = {w: [x for x in v if apart(w, x)] for w in v}
    form = {w: x for w in v if near[w] and v[x := min(near[w], key=lambda x: (-v[x], x))] >= 2 * v[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), v[form[w]] if w in form else None) for w, n in v.items()}


def variants(spark, rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs_of(spark, rows)).collect()}


def test_variants_equal_all_pairs(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abé") for _ in range(r.randint(4, 9))) for _ in range(250)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÀÀÀÀÀ", "ÀÀÀÀÀÀ", "z" * 400, "z" * 401, "z" * 399 + "y"]
    rows = [(i, " ".join(w for w in words for _ in range(r.choice((0, 0, 1, 2, 9))))) for i in range(12)] + [(20, None), (21, ""), (22, "one x"), (None, "Aaaaa AAAAA aaaaA"), (0, "aaaaa-aaaaa"), (0, "aaaaa-aaaaa")]
    want = plain_variants(plain_words(rows))
    assert len(want) > 150 and any(a for a, *_ in want.values()) and variants(spark, rows) == want


def test_variants_of_long_lists_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 5)  # nearly every list is dealt over blocks
    r = random.Random(4)
    rows = [(i, " ".join("qu" + "".join(r.choice("ab") for _ in range(r.randint(3, 6))) for _ in range(200))) for i in range(8)]
    assert variants(spark, rows) == plain_variants(plain_words(rows))


def test_variants_of_empty_tables(spark):
    assert variants(spark, []) == {} and variants(spark, [(1, None), (2, "a b")]) == {}


def test_chain_of_forms_ends_at_its_root(spark):
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate((("aaaaabbbb"[: 5 + k], 3 * 2**k) for k in range(5)))]
    got = variants(spark, rows)
    assert got == plain_variants(plain_words(rows)) and len({x[1] for x in got.values()}) < len(got)


# --- secrets


@pytest.fixture(scope="module")
def field(spark):
    return secret_scan.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def plain_base(text):
    out = []
    for k, (p, least, g) in enumerate(((secret_scan.ASSIGN, 6, 2), (re.compile("AKIA[A-Z0-9]+"), 20, 0), (re.compile("[0-9a-f]+"), 24, 0))):
        out += [(m.start(), k, m.end()) for m in p.finditer(text or "") if len(m[g]) >= least]
    return sorted(out)


TEXTS = [(1, 'é token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" x'), (1, 'é token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" x'), (2, None), (3, ""), (4, "PASSWORD:abc PASSWD=abcdef api_key: 'QWERTY' apikey=x"), (5, "AKIA" + "Z9" * 8 + " AKIASHORT"), (6, "0123456789abcdef01234567\U0001f333 0123456789abcdef0123456"), (7, "x " * 200_000), (8, "ſecret=abcdefgh toKen=abcdefgh"), (None, "secret: ======")]


def test_base_spans_equal_plain_search(spark, field):
    rows = TEXTS + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.secret_report(docs_of(spark, rows), field).collect())
    want = []
    for i, t in rows:
        base = plain_base(t)
        told = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        want.append((str(i), *(sum(k == j for _, k, _ in base) for j in range(3)), hashlib.sha256(told.encode()).hexdigest()))
    assert got == sorted(want) and any(w[1] for w in want) and any(w[2] for w in want)


def test_best_tags_equal_all_paths(field):
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        scores, text = r.normal(size=(n, 3)) * 4, np.sort(r.integers(0, 3, n))
        total = lambda tags: sum(scores[i, t] for i, t in enumerate(tags)) + sum(
            field.moves[a, b] for k in set(text.tolist()) for a, b in itertools.pairwise([0, *(t for t, j in zip(tags, text) if j == k), 0])
        )
        best = max(itertools.product(range(3), repeat=n), key=total)
        for cut in (False, True):
            assert tuple(field.decode(scores, text, cut)) == best


def test_sure_tokens_change_no_tag(spark, field):
    texts = [r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [b"password is Summer2024! and key: ghp_abcdefghij0123456789ABCDEFGHIJ"]
    tokens = secret_scan.Tokens(texts)
    scores = field.scores(tokens.rows)
    last = np.concatenate([tokens.text[1:] != tokens.text[:-1], [True]])
    assert field.outside(scores, last).mean() > 0.5
    assert (field.decode(scores, tokens.text, True) == field.decode(scores, tokens.text, False)).all()


def test_tokens_and_spans_of_places(field):
    assert secret_scan.scan(["", "a", "é" * 5], field) == [[], [], []]
    t = secret_scan.Tokens([b"ab=c1", b"", "é!".encode()])
    assert [(int(i), int(s - t.begin[i]), int(e - t.begin[i])) for i, s, e in zip(t.text, t.start, t.end)] == [(0, 0, 2), (0, 2, 3), (0, 3, 5), (2, 0, 2), (2, 2, 3)]


def found(field, cases):
    """The share of secrets whose place a span of any kind covers for the most part."""
    texts, spans = zip(*cases)
    hits = [any(min(e, b) - max(s, a) > 0.8 * (b - a) for s, _, e in x) for x, (a, b) in zip(secret_scan.scan(list(texts), field), spans)]
    return sum(hits) / len(hits)


def held_out(spark, forms, seed=77, n=300):
    r = random.Random(seed)
    carriers = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 7 = 3").orderBy("doc_id").limit(n).collect()]
    for text in carriers:
        before, secret, after = secret_scan.planted(r, forms)
        at = text.find(" ", 60) + 1
        yield f"{text[:at]}{before}{secret}{after} {text[at:400]}", (at + len(before), at + len(before) + len(secret))


def test_secrets_in_texts_kept_apart_are_found(spark, field):
    shares = {form: found(field, list(held_out(spark, (form,)))) for form in secret_scan.FORMS}
    assert min(shares.values()) > 0.8 and sum(shares.values()) / len(shares) > 0.92, shares


def test_forms_that_training_has_not_seen_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for left_out in (("jwt", "prefixed"), ("base64", "dashed")):
        kept = tuple(f for f in secret_scan.FORMS if f not in left_out)
        share = found(secret_scan.fit(docs, forms=kept), list(held_out(spark, left_out)))
        assert share > 0.6, (left_out, share)


def test_lookalikes_and_clean_texts_stay(spark, field):
    r = random.Random(8)
    texts = [f"{secret_scan._any(r, 'abcdefg ', 30, 60)} {secret_scan.lookalike(r)} and so on" for _ in range(400)]
    wrong = sum(any(k == 3 for _, k, _ in x) for x in secret_scan.scan(texts, field))
    assert wrong / len(texts) < 0.05
    clean = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if not plain_base(x.text)]
    assert sum(any(k == 3 for _, k, _ in x) for x in secret_scan.scan(clean, field)) / len(clean) < 0.03
