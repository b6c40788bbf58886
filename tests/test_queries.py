"""Queries against their SQL on the smallest tables, and rules that the segmentation keeps."""

import datetime
import math

import duckdb
import pytest

from pyspark.sql import functions as F

from lexloom.functions import rules
from lexloom.operators import evidence, intake, segment, vector
from lexloom.plans import registry
from lexloom.sources import books
from lexloom.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if math.isfinite(v) else v
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    res = duck.sql(registry.SQL[name])
    assert sorted(res.columns) == names
    at = [res.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=str)


def test_segments_cover_all_paragraphs(spark):
    p = spark.createDataFrame([(1, i, "x" * (7 * i % 50)) for i in range(1, 40)], "doc_id long, paragraph_index int, text string")
    rows = sorted(map(tuple, segment.packed_segments(p, budget=60).collect()))
    assert rows[0][1] == 1 and rows[-1][2] == 39 and all(a[2] + 1 == b[1] for a, b in zip(rows, rows[1:]))


def test_windows_in_a_scene(spark):
    b = spark.createDataFrame([(1, 1, 1, 9)], "doc_id long, scene_index int, paragraph_start int, paragraph_end int")
    assert sorted((r.window_start, r.window_end) for r in segment.windows_in(b, 5, 2).collect()) == [(1, 5), (4, 8), (5, 9)]


HITS = "query_id int, doc_id long, paragraph_index int, score double"
SCENES = "doc_id long, scene_index int, paragraph_start int, paragraph_end int"


def slices_of(spark, at, scenes=(), **shape):
    found = evidence.slices(spark.createDataFrame([(1, d, p, 1.0) for d, p in at], HITS), spark.createDataFrame(list(scenes), SCENES), **shape)
    return sorted((r.doc_id, r.paragraph_start, r.paragraph_end, r.hits, r.reason) for r in found.collect())


def test_slices_of_hits(spark):
    dense = [(17, p) for p in (37, 39, 41, 45, 47, 51, 56)]
    assert slices_of(spark, dense + dense) == [(17, 31, 62, 7, "clustered_hits")]
    assert slices_of(spark, [(1, 3), (1, 58), (1, 140), (4, 9), (9, 220)]) == []
    assert slices_of(spark, [(1, 10), (1, 20), (1, 30)], margin=20, width=24) == [(1, 9, 32, 3, "clustered_hits")]
    assert slices_of(spark, [(1, 10), (1, 11), (1, 12)], [(1, 4, 8, 14)]) == [(1, 8, 14, 3, "clustered_hits")]
    assert slices_of(spark, [(1, 20), (1, 35), (1, 47)], [(1, 1, 1, 120)]) == [(1, 14, 53, 3, "clustered_hits"), (1, 54, 101, 0, "scene_continuation")]
    two = [(1, p) for p in (5, 6, 7, 8)] + [(2, p) for p in (5, 6, 7)] + [(3, p) for p in (50, 51, 52)]
    assert slices_of(spark, two) == [(1, 1, 14, 4, "clustered_hits"), (2, 1, 13, 3, "clustered_hits")]
    assert len(slices_of(spark, two, most=3)) == 3 and slices_of(spark, []) == []


def test_fusion_prefers_what_both_lists_have(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, ref long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, ref long, rank int")
    assert [r.ref for r in sorted(vector.fused(a, b).collect(), key=lambda r: r.rank)] == [11, 10, 12]


def test_html_and_fb2_blocks():
    assert [b[:3] for b in books.blocks_of("<h1>T</h1><p>a <i>b</i></p><script>x</script><blockquote>q</blockquote>")] == [("heading", 1, "T"), ("paragraph", 0, "a b"), ("quote", 0, "q")]
    fb2 = "<FictionBook><body><section><title><p>One</p></title><p>text</p></section></body></FictionBook>".encode()
    assert [r[3:6] for r in books.book_rows("x.fb2", fb2)] == [("heading", 1, "One"), ("paragraph", 0, "text")]
    assert list(books.book_rows("x.txt", b""))[0][-1] == "UNSUPPORTED"


def test_stream_equals_batch(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.series(events.source(spark, str(tmp_path / "in")), late="60 days")
    q = stream.writeStream.format("memory").queryName("series").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(turns) from series").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def col(spark, expr, **values):
    return spark.range(1).select(expr(**{k: F.lit(v) for k, v in values.items()}).alias("x")).first().x


def test_rules_on_single_values(spark):
    def lock(s):
        h = 0x811C9DC5
        for unit in memoryview(s.encode("utf-16-le")).cast("H"):
            h = (h ^ unit) * 0x01000193 & 0xFFFFFFFF
        return h - 2**32 if h >= 2**31 else h

    for s in ("", "book:1", "Книга 7", "a\U0001f333b"):
        assert col(spark, rules.lock_key, text=s) == lock(s)
    errors = {"HTTP status: 503": True, "status=404": False, "Socket hang up": True, "status 429 x": True, "invalid": False, "": False}
    assert {m: col(spark, rules.retriable, message=m) for m in errors} == errors
    answers = {' {"a": 1} ': '{"a": 1}', '```json\n{"a": 2}\n``` {': '{"a": 2}', 'x {"a": {"b": 3}} y': '{"a": {"b": 3}}', "{oops": None, "": None, "[1]": None}
    assert {t: col(spark, rules.lenient_json, text=t) for t in answers} == answers
    long = "a plain summary of what was said in the talk about whales and the sea, told anew"
    assert [spark.range(1).select(rules.suspicious(F.lit(s), F.array(*map(F.lit, src))).alias("x")).first().x for s, src in (("short", [""]), ("ab" + "A" * 70, [""]), (long, ["other words of some length here"]), (long, ["He said: " + long.upper()]), (long, [long]))] == [True, True, False, True, True]
    levels = [(0.8, ["rerank"], "high"), (0.1, ["semantic", "lexical"], "high"), (0.6, ["semantic"], "medium"), (0.1, ["rerank", "lexical"], "medium"), (0.5, ["lexical"], "low"), (0.9, ["lexical"], "medium")]
    assert [spark.range(1).select(rules.confidence(F.lit(s), F.array(*map(F.lit, by))).alias("x")).first().x for s, by, _ in levels] == [x for *_, x in levels]


def test_intake_operators_on_ties_nulls_and_empty_tables(spark):
    q = spark.createDataFrame([(1, 0, " A  b"), (1, 1, "a b"), (1, 2, " "), (1, 3, None), (1, 4, "c")], "g int, o int, query string")
    assert [r["query"] for r in intake.query_pool(q, "g", ["o"]).orderBy("place").collect()] == ["A  b", "c"]
    assert intake.query_pool(q, "g", ["o"], most=1).count() == 1 and intake.query_pool(q.limit(0), "g", ["o"]).count() == 0
    i = spark.createDataFrame([(1, "a", 0), (1, None, 1), (1, "a", 2), (1, " ", 3), (2, "a", 0)], "g int, raw string, position int")
    assert [r.unique_id for r in intake.unique_ids(i, "g", "raw", "position").orderBy("g", "position").collect()] == ["a", "record_1", "a__dup_1_2", "record_3", "a"]
    r = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 8, 3), (1, 9, 4), (2, 7, 1)], "user_id int, item int, at int")
    added = intake.with_slots(r, spark.createDataFrame([(1, 3)], "user_id int, n int"))
    assert sorted((x.user_id, x.item, x.added) for x in added.collect()) == [(1, 7, True), (1, 8, True), (1, 9, False), (2, 7, True)]
    u = spark.createDataFrame([("1-3 | s | b1; B1; b2 | a | c", 1, 9), ("4\t6\tsum\tb\ta; a", 1, 9), ("8 — 12 | s | b | a | c", 1, 9), ("x | 2 | s | b | a", 1, 9), ("1|2|s| ; |a", 1, 9), ("```", 1, 9), (None, 1, 9), ("1-2 | s | b | a", 1, 9)], "line string, lo int, hi int")
    assert sorted((x.paragraph_start, x.paragraph_end, x.beats, x.anchors, x.error) for x in intake.search_units(u).collect()) == [(1, 2, [], ["a"], "no beats"), (1, 3, ["b1", "b2"], ["a", "c"], None), (4, 6, ["b"], ["a"], None), (8, 12, ["b"], ["a", "c"], "outside")]
    b = intake.block_offsets(spark.createDataFrame([(1, " a\r\n\r\n\r\nb c \n\n\n d"), (2, None), (3, "")], "doc_id int, text string"))
    assert sorted((x.doc_id, x.block, x.start_char, x.end_char, x.text) for x in b.collect()) == [(1, 1, 0, 1, "a"), (1, 2, 3, 10, "b c\n\n d")]
