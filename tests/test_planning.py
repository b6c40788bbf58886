"""Plans, histories and showcases on single cases; joins by either key; segmentation responses as a whole."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import groups, intake, planning
from lexloom.sources import sinks


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_search_plan_bounds_and_empties(spark):
    assert one(spark, "{}", planning.search_plan) is None and one(spark, '{"notes": ["n"]}', planning.search_plan) is None and one(spark, "no json", planning.search_plan) is None
    p = one(spark, json.dumps({"normalizedQuestion": " a \n b ", "broadQueries": ["x", " x ", "", None, "y"], "focusedQueries": ["y", "z"], "searchQueries": ["z"], "queryGroups": [{"part": " "}, {"part": "p", "focusedQueries": [str(i) for i in range(9)]}]}), planning.search_plan)
    assert p.normalizedQuestion == "a b" and p.searchQueries == ["z", "x", "y"] and p.broadQueries == ["x", "x", "y"] and [(g.part, g.searchQueries) for g in p.queryGroups] == [("p", list("012345"))]


@pytest.mark.parametrize(("n", "through", "expected"), [(5, 1, ("pass", 0, 1)), (6, None, ("regenerate", 2, 3)), (6, 2, ("exact", 2, 3)), (8, 2, ("reuse", 2, 3)), (8, 1, ("reuse", 1, 2)), (9, 1, ("regenerate", 5, 6)), (9, 2, ("reuse", 2, 3)), (9, 6, ("regenerate", 5, 6)), (9, 0, ("regenerate", 5, 6))])
def test_history_boundaries(spark, n, through, expected):
    r = planning.compacted(spark.createDataFrame([(n, through)], "n int, through int")).first()
    assert (r.action, r.summary_through, r.inline_from) == expected


SHOWCASE = {
    "themes": [{"name": "Love", "description": "d"}, {"name": "LOVE", "description": "e"}, {"name": " ", "description": "x"}, {"name": "War", "description": "w" * 400}, {"name": "No text"}],
    "characters": [{"name": "B", "description": "d", "rank": 2}, {"name": "A", "description": "d", "rank": "1"}, {"name": "b", "description": "again", "rank": 1}, {"name": "Z", "description": "d", "rank": 99}, {"name": "Y", "description": "d", "rank": -4}],
    "events": [{"title": "t", "description": "d", "importance": " HIGH "}, {"title": "u", "description": "d", "importance": "low"}, {"title": "T", "description": "d", "importance": "medium"}],
    "quotes": [{"text": "short"}, {"text": "long enough to stay", "chapterOrderIndex": "3", "chapterTitle": " "}, {"text": "LONG enough to stay"}],
}


def test_showcase_is_validated_and_upserted(spark, tmp_path):
    df = spark.createDataFrame([("b1", json.dumps(SHOWCASE)), ("b2", None), ("b3", "[]")], "book string, j string")
    rows = {(r.book, r.kind): json.loads(r.content) for r in planning.showcase_rows(df, "book", "j").collect()}
    assert [t["name"] for t in rows["b1", "showcase_themes"]] == ["Love", "War"] and len(rows["b1", "showcase_themes"][1]["description"]) == 320 and rows["b1", "showcase_themes"][1]["description"].endswith("\u2026")
    assert [(c["name"], c["rank"]) for c in rows["b1", "showcase_characters"]] == [("A", 1), ("b", 2), ("Y", 3), ("Z", 4)]
    assert [(e["title"], e["importance"]) for e in rows["b1", "showcase_events"]] == [("t", "high")]
    assert rows["b1", "showcase_quotes"] == [{"text": "long enough to stay", "chapterOrderIndex": 3}]
    assert all(rows[b, f"showcase_{k}"] == [] for b in ("b2", "b3") for k in ("themes", "characters", "events", "quotes"))
    path, key = str(tmp_path / "t"), ["book", "kind", "key"]
    first = planning.showcase_rows(df, "book", "j").withColumn("updated", F.lit(1))
    sinks.create(first, path, key, buckets=3)
    assert sinks.buckets_of(spark, path, 64) == 3
    sinks.upsert(first, path, key, "updated")
    sinks.upsert(first.where("kind = 'showcase_themes'").withColumns({"updated": F.lit(2), "content": F.lit("[]")}), path, key, "updated")
    kept = {(r.book, r.kind): (r.content, r.updated) for r in sinks.table(spark, path, key).collect()}
    assert len(kept) == 12 and kept["b1", "showcase_themes"] == ("[]", 2) and kept["b1", "showcase_events"][1] == 1


def test_sinks_keep_columns_of_any_name_and_refuse_their_own(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", True, 1)], "id int, r string, is_new boolean, updated int")
    path = str(tmp_path / "t")
    sinks.create(rows, path, ["id"])
    sinks.upsert(rows, path, ["id"], "updated")
    sinks.insert_absent(rows.withColumn("id", F.lit(2)), path, ["id"])
    assert sorted(map(tuple, sinks.table(spark, path, ["id"]).select("id", "r", "is_new", "updated").collect())) == [(1, "x", True, 1), (2, "x", True, 1)]
    with pytest.raises(ValueError):
        sinks.upsert(rows.withColumn("__new", F.lit(1)), path, ["id"], "updated")


def test_segmentation_responses_whole(spark):
    unit = "{}-{} | s | b | a | c".format
    cases = {
        "gap": (f"{unit(1, 3)}\n{unit(6, 9)}", [(1, 5), (6, 9)]), "overlap": (f"{unit(1, 5)}\n{unit(4, 9)}", [(1, 5), (6, 9)]), "swallowed": (f"{unit(1, 6)}\n{unit(2, 3)}\n{unit(7, 9)}", [(1, 6), (7, 9)]),
        "stretched": (f"{unit(3, 4)}\n{unit(5, 7)}", [(1, 4), (5, 9)]), "unsorted": (f"{unit(5, 9)}\n```\n{unit(1, 4)}", [(1, 4), (5, 9)]), "outside": (f"{unit(1, 4)}\n{unit(5, 10)}", (2, "outside")), "turned": (unit(4, 3), (1, "outside")),
        "no beats": ("1-9 | s | ; | a | c", (1, "no beats")), "four parts": ("1-9 | s | b | a", (None, "no units")), "nothing": ("```\nfoo", (None, "no units")), "empty": (" \n ", (None, "empty response")), "null": (None, (None, "empty response")), "no anchors": ("1\t9\ts\tb\t ;", (1, "no anchors")),
    }
    rows = [(i, c, 1, 9) for i, (c, _) in enumerate(cases.values())]
    scenes, errors = intake.segmentation(spark.createDataFrame(rows, "segment_id int, content string, lo int, hi int"))
    got = {i: [] for i in range(len(rows))}
    for r in scenes.orderBy("segment_id", "scene_index").collect():
        got[r.segment_id].append((r.paragraph_start, r.paragraph_end))
    bad = {r.segment_id: (r.line, r.error) for r in errors.collect()}
    for i, (name, (_, want)) in enumerate(cases.items()):
        assert (got[i] or bad.get(i)) == want and not (got[i] and i in bad), name


def test_either_key_finds_one_two_or_none(spark):
    left = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, None, "b"), (4, 99, None), (5, 20, "z")], "n int, id int, k string")
    right = spark.createDataFrame([(10, "a", "ten"), (20, "b", "twenty"), (None, None, "none")], "id int, k string, v string")
    got = sorted((r.n, r.v or "") for r in intake.either_join(left, right, (["id"], ["k"]), ["v"]).collect())
    assert got == [(1, "ten"), (2, "ten"), (2, "twenty"), (3, "twenty"), (4, ""), (5, "twenty")]


def test_groups_merge_within_the_bound_and_split(spark):
    rows = [(1, 1, 1, 2, 1, 0.5, ["lexical"]), (1, 1, 3, 4, 2, 0.7, ["semantic"]), (1, 1, 5, 6, 3, 0.2, ["lexical"]), (1, 1, 6, 8, 4, 0.1, ["lexical"]), (1, 2, 10, 19, 1, 0.9, ["rerank"]), (2, 1, 3, 3, 1, 0.1, ["lexical"])]
    g = groups.merged(spark.createDataFrame(rows, "query_id int, doc_id long, paragraph_start int, paragraph_end int, rank int, score double, matched_by array<string>"))
    got = sorted((r.query_id, r.doc_id, r.paragraph_start, r.paragraph_end, r.score, r.confidence) for r in g.collect())
    assert got == [(1, 1, 1, 4, 0.7, "high"), (1, 1, 5, 8, 0.2, "low"), (1, 2, 10, 13, 0.9, "high"), (1, 2, 14, 17, 0.9, "high"), (1, 2, 18, 19, 0.9, "high"), (2, 1, 3, 3, 0.1, "low")]
    assert groups.merged(g.limit(0).withColumn("rank", F.lit(1))).count() == 0


@pytest.mark.parametrize("text", ["", "a", "abc", "abcd", "aaaaaa", "é\nb cd", "a\U0001f333b\U0001f333c", "x" * 50 + "yz"])
def test_ngrams_of_any_plane(spark, text):
    from lexloom.functions import text as T

    want = [text] if 0 < len(text) <= 3 else list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))
    assert one(spark, text, T.ngrams) == want
