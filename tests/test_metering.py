"""Prices, costs, versions and ranking anew on single cases."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import rules
from lexloom.operators import metering


def test_prices_by_entry_wildcard_and_fallback(spark):
    catalogue = spark.createDataFrame([("Pro-1", 9, 2.0, 12.0), ("pro*", 5, 1.0, 6.0), ("p*", 1, 0.5, None), ("*", 10, -1.0, 0.1)], "pattern string, place int, input_price double, output_price double")
    usage = spark.createDataFrame([(" PRO-1",), ("pro-2",), ("lite",), ("",), (None,)], "model string")
    got = {r.model: (r.input_price, r.output_price) for r in metering.priced(usage, catalogue, (7.0, 8.0)).collect()}
    assert got == {" PRO-1": (2.0, 12.0), "pro-2": (0.5, 8.0), "lite": (7.0, 0.1), "": (7.0, 8.0), None: (7.0, 8.0)}
    assert metering.priced(usage.limit(0), catalogue).count() == 0 and metering.priced(usage, catalogue.limit(0)).count() == 5


@pytest.mark.parametrize(("tokens", "usd"), [((1_000_000, 0, 0), 2.0), ((1_000_000, 500_000, 0), 1.1), ((100, 1_000_000, 0), 100 / 1e6 * 0.2), ((-5, 10, 1_000_000), 12.0), ((None, None, None), 0.0)])
def test_costs(spark, tokens, usd):
    df = spark.createDataFrame([tokens], "i long, c long, o long").select(metering.cost(F.col("i"), F.col("c"), F.col("o"), F.lit(2.0), F.lit(12.0)).alias("x"))
    assert df.first().x == pytest.approx(usd)


def test_stages_of_nothing_but_waiting_chapters(spark):
    rows = [("r", "scenes", 2, "queued", None, None, None, {}, 1), ("r", "scenes", 1, "queued", "2024", None, "ignored", {"a": -5, "b": 2}, None), ("s", "scenes", 1, "failed", None, None, "", {"a": 1}, 3), ("s", "scenes", 2, "completed", "1", "2", "late", None, 4)]
    df = spark.createDataFrame(rows, "run string, stage string, chapter int, state string, started string, completed string, error string, storage map<string, bigint>, tokens long")
    got = {r.run: (r.tokens, r.state, r.started, r.completed, r.error, r.storage) for r in metering.stage_rollup(df, ["run", "stage"], "chapter", ["tokens"]).collect()}
    assert got == {"r": (1, "queued", "2024", None, None, {"a": 0, "b": 2}), "s": (7, "failed", "1", "2", "late", {"a": 1})}
    stages = spark.createDataFrame([("a", "finalize", "queued"), ("a", "scenes", "running"), ("b", "fragments", "failed"), ("b", "paragraphs", "running"), ("c", "odd", "failed"), ("d", "scenes", "completed"), ("e", "scenes", "failed")], "run string, stage string, state string")
    now = {r.run: r.current_stage for r in metering.current_stage(stages, "run", F.col("run") == "e").collect()}
    assert now == {"a": "scenes", "b": "fragments", "c": "finalize", "d": "finalize", "e": "finalize"}


def test_versions_behind_stored_ones(spark):
    stored = spark.createDataFrame([("b", 1, "x", 2), ("b", 2, "y ", 3)], "book string, version int, sha string, attempts int")
    uploads = spark.createDataFrame([("b", 1, "y"), ("b", 2, "y"), ("b", 3, "x"), ("b", 4, "y"), ("c", 1, "q"), ("c", 2, None)], "book string, at int, sha string")
    got = [(r.book, r["at"], r.version, r.attempt) for r in metering.versions(uploads, stored, "book", ["at"], "sha").orderBy("book", "at").collect()]
    assert got == [("b", 1, 2, 4), ("b", 2, 2, 5), ("b", 3, 3, 1), ("b", 4, 4, 1), ("c", 1, 1, 1), ("c", 2, 2, 1)]


def test_ranking_sends_eighty_and_keeps_order_without_it(spark):
    c = spark.createDataFrame([(q, r, r, f"id{r % 50}", "", "text" * 1000) for q in (1, 2, 3) for r in range(1, 101)], "query_id int, ref int, rank int, id string, title string, content string")
    status = spark.createDataFrame([(1, True, None), (2, False, None), (3, True, "down")], "query_id int, enabled boolean, failure string")
    seen = {}

    def model(sent):
        seen["n"], seen["chars"] = sent.count(), sent.select(F.max(F.length("content"))).first()[0]
        return sent.where("position >= 78").select("query_id", "unique_id", F.col("position").alias("score"))

    got = {}
    for r in metering.ranked_anew(c, status, model, 5).orderBy("query_id", "place").collect():
        got.setdefault((r.query_id, r.used, r.error), []).append(r.ref)
    assert got == {(1, True, None): [80, 79, 1, 2, 3], (2, False, None): [1, 2, 3, 4, 5], (3, False, "down"): [1, 2, 3, 4, 5]} and seen == {"n": 80, "chars": 3200}


def test_anchored_months_as_columns(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-31 10:30:00.25' AS a, k, t FROM VALUES (0, TIMESTAMP '2024-02-29 10:30:00.25'), (1, TIMESTAMP '2024-02-29 10:30:00.2'), (13, TIMESTAMP '2023-12-31 10:30:01') AS v(k, t)")
    got = [(str(r.m), r.p) for r in df.select("k", rules.month_on(F.col("a"), F.col("k")).alias("m"), rules.period_of(F.col("a"), F.col("t")).alias("p")).orderBy("k").collect()]
    assert got == [("2024-01-31 10:30:00.250000", 1), ("2024-02-29 10:30:00.250000", 0), ("2025-02-28 10:30:00.250000", -1)]
