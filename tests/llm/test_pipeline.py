"""The pipeline's stages on a small table, each against a plain version of its decision, and the whole run."""

import collections
import re

import pytest

import corpus_pipeline
from lexloom.llm import pattern_packing, pii, quality_rules, source_mixing

SF = "/root/testdata/sf0.001"


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]



@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with nulls, empty, long and repeated rows and an extra column, and their labels, as Parquet."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    base = " ".join(f"word{i}" for i in range(80))
    docs += [(9000, base, "en", "src1", len(base)), (9001, base.replace("word70 ", "other "), "en", "src1", len(base)), (9002, base, None, None, None), (9003, None, "en", "src1", 0), (9004, "", None, "src2", 0)]
    docs += [(9005, " ".join(f"long{i}" for i in range(20_000)), "de", "src2", 1), (9005, " ".join(f"long{i}" for i in range(20_000)), "de", "src2", 1), (None, base + " unnamed", "en", "src1", 1)]
    docs += [(9006, " ".join(f"plain{i}" for i in range(60)) + " write to some.one@mail.example.com today", "en", "src1", 1)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, lang string, source string, n_chars long, component string").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def staged(spark, tables, tmp_path_factory):
    """What each stage returned, written and read again."""
    docs, out = spark.read.parquet(f"{tables}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, tables).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(spark, tables, staged):
    columns = spark.read.parquet(f"{tables}/documents.parquet").columns
    assert all(df.columns == columns for df in staged[:-1])


def test_quality_stage(spark, tables, staged):
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_report(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")).collect()}
    all_ids = [r.doc_id for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert sorted(map(str, (r.doc_id for r in staged[0].collect()))) == sorted(str(i) for i in all_ids if verdict[i])
    assert not verdict[9003] and not verdict[9004] and verdict[9000]


def test_near_duplicates_stage(staged):
    rows = [(r.doc_id, r.text) for r in staged[0].collect() if r.doc_id is not None]
    sets = {i: {tuple(w[j : j + 5]) for w in [words(t.lower())] for j in range(max(1, len(w) - 4))} for i, t in rows}
    label = {i: i for i in sets}
    post = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            post[x].append(i)
    pairs = {(a, b) for group in post.values() for a in group for b in group if a < b}
    linked = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in label:
        before = dict(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = [r.doc_id for r in staged[1].collect()]
    assert sorted(i for i in got if i is not None) == sorted(set(label.values())) and got.count(None) == 1
    assert 9000 in got and 9001 not in got and 9002 not in got and got.count(9005) == 1


def test_personal_data_stage(staged):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in staged[1:3])
    assert before.keys() == after.keys() and "<email>" in after[9006] and "example.com" not in after[9006]
    spans = {r.doc_id: r.spans for r in pii.span_report(staged[1]).collect()}
    for i, t in before.items():
        at, out = 0, []
        for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans[i].split(",") if x)):
            if b > at:
                out += [t[at:a], f"<{kind}>"] if a >= at else []
                at = b
        assert after[i] == "".join(out) + t[at:], i


def test_mixture_and_packing_stages(staged):
    copies = {r.doc_id: r.copies for r in source_mixing.mix(staged[2]).collect() if r.doc_id is not None}
    taken = collections.Counter(r.doc_id for r in staged[3].collect())
    assert taken == {i: c for i, c in copies.items() if c}
    want = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pattern_packing.pieces(staged[3], pattern_packing.tokenizer_path()).collect())
    made = staged[4].collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made) == want
    placed = collections.defaultdict(list)
    for r in made:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    assert -(-sum(r.length for r in made) // 4096) <= len(placed) <= -(-sum(r.length for r in made) // 4096) + 3


def test_run_is_the_stages_in_turn(spark, tables, staged):
    rows = lambda df: collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, tables)) == rows(staged[-1])


def test_sequences_hold_all_tokens(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "word " * 9000)], "doc_id long, text string")
    made = pattern_packing.sequences(docs).collect()
    ids = pattern_packing.pieces(docs, pattern_packing.tokenizer_path())
    assert sum(len(r.ids) for r in made) == ids.selectExpr("sum(length)").first()[0] and max(len(r.ids) for r in made) <= 4096
    assert sum(r.ids.count(1) for r in made) == 3
