"""Streams with state: rows out of order over several micro-batches, a restart, and timers that remove state; claims by batch."""

import datetime
import random

import pytest

from lexloom.streaming import events, stateful

T0 = datetime.datetime(2024, 1, 31, 10, 30, 0, 250_000, tzinfo=datetime.UTC)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def ms(t):
    return int(t.timestamp() * 1000)


def run(spark, tmp_path, batches, schema, key, processor, restarts=(), late="60 days"):
    """What a processor makes of batches, each a file and a micro-batch; the query is started again before those in restarts."""
    stateful.configured(spark)
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    source = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        if source is None or i in restarts:
            source = spark.readStream.schema(schema).parquet(str(folder))
        made = stateful.stateful(source, key, processor, late)
        q = made.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
    return sorted(map(tuple, spark.read.parquet(str(out)).collect())), q


CHATS = "user_id long, session long, ts timestamp, id long, kind string, text string"


def test_sessions_out_of_order_over_restarts(spark, tmp_path):
    idle = 30 * 60_000
    said = [(1, 1, at(0), 1, "begin", None), (1, 1, at(1), 2, "append", "a"), (1, 1, at(2), 3, "status", "busy"), (1, 1, at(3), 4, "append", "b"), (1, 1, at(5), 5, "end", None), (1, 1, at(6), 6, "append", "lost"),
            (2, 1, at(0), 7, "append", "before"), (2, 1, at(1), 8, "begin", None), (2, 1, at(2), 9, "append", "x"), (2, 1, at(40), 10, "append", "late"), (2, 2, at(3), 11, "begin", None), (2, 2, at(20), 12, "begin", None), (2, 2, at(21), 13, "append", None), (2, 2, at(22), 14, "end", None)]
    r = random.Random(2)
    mixed = said[:]
    r.shuffle(mixed)
    flush = [(9, 9, at(10_000), 99, "begin", None)], [(9, 9, at(10_001), 100, "append", "z")]
    got, q = run(spark, tmp_path, [mixed[:5], mixed[5:10], mixed[10:], *flush], CHATS, ["user_id", "session"], stateful.Sessions(idle), restarts=(1, 3), late="1 day")
    want = [(1, 1, "ended", "ab", "busy", ms(at(0)), ms(at(5)), 2), (2, 1, "expired", "x", None, ms(at(1)), ms(at(2)) + idle, 1), (2, 2, "ended", "", None, ms(at(20)), ms(at(22)), 1)]
    assert got == sorted(want)
    assert q.lastProgress["stateOperators"][0]["customMetrics"]["numDeletedStateVars"] >= 0


def test_folding_does_not_depend_on_batches():
    """The same rows at once, one by one, and by random cuts of the watermark."""
    r, p = random.Random(5), stateful.Watchdog()
    rows = sorted((ms(at(r.randint(0, 4000))), i, r.choice(("queued", "running", "done"))) for i in range(60))
    whole = p.folded(("k",), None, rows, ms(at(100_000)))
    for _ in range(20):
        cuts = sorted({ms(at(r.randint(0, 4000))) for _ in range(r.randint(1, 9))} | {ms(at(100_000))})
        state, out, done = None, [], 0
        for c in cuts:
            now = [x for x in rows[done:] if x[0] <= c]
            state, made = p.folded(("k",), state, now, c)
            done, out = done + len(now), out + made
        assert (state, out) == whole


def test_watchdog_requeues_and_fails(spark, tmp_path):
    rows = [(1, at(0), 1, "queued"), (1, at(5), 2, "running"), (1, at(20), 3, "done"), (2, at(0), 4, "running"), (3, at(0), 5, "queued")]
    got, _ = run(spark, tmp_path, [rows[3:], rows[:3], [(9, at(9_000), 9, "done")], [(9, at(9_001), 10, "done")]], "job long, ts timestamp, id long, state string", ["job"], stateful.Watchdog(), late="1 day")
    want = [(2, "requeue", "running", ms(at(45)), 1)] + [(2, "requeue", "queued", ms(at(45 + 10 * i)), i + 1) for i in range(1, 5)] + [(2, "fail", "queued", ms(at(95)), 5)]
    want += [(3, "requeue", "queued", ms(at(10 * i)), i) for i in range(1, 6)] + [(3, "fail", "queued", ms(at(60)), 5)]
    assert got == sorted(want)


def test_quotas_by_anchored_month(spark, tmp_path):
    days = [0, 1, 28, 29, 30, 59, 60, 61, 200]
    rows = [(1, T0 + datetime.timedelta(days=d), i, "pro" if i % 3 else "lite", ms(T0)) for i, d in enumerate(days)]
    got, _ = run(spark, tmp_path, [rows[5:] + rows[:1], rows[1:5], [(9, at(60 * 24 * 900), 99, "pro", 0)], [(9, at(60 * 24 * 901), 98, "pro", 0)]], "user_id long, ts timestamp, id long, kind string, anchor long", ["user_id"], stateful.Quotas(), late="250 days")
    bounds = [datetime.datetime(2024, m, d, 10, 30, 0, 250_000, tzinfo=datetime.UTC) for m, d in ((1, 31), (2, 29), (3, 31), (4, 30), (5, 31), (6, 30), (7, 31), (8, 31))]
    want = []
    for a, b in zip(bounds, bounds[1:]):
        inside = [k for _, t, _, k, _ in rows if a <= t < b]
        if inside:
            want.append((1, ms(a), ms(b), inside.count("pro"), inside.count("lite")))
    assert [x for x in got if x[0] == 1] == want and len(want) == 4


def test_months_from_an_anchor():
    for k, day in ((0, (2024, 1, 31)), (1, (2024, 2, 29)), (2, (2024, 3, 31)), (11, (2024, 12, 31)), (12, (2025, 1, 31)), (13, (2025, 2, 28)), (-1, (2023, 12, 31))):
        assert stateful.month_on(ms(T0), k) == ms(datetime.datetime(*day, 10, 30, 0, 250_000, tzinfo=datetime.UTC))
        assert stateful.period_of(ms(T0), stateful.month_on(ms(T0), k)) == k and stateful.period_of(ms(T0), stateful.month_on(ms(T0), k) - 1) == k - 1


@pytest.mark.parametrize("what", ["allowed", "idempotent"])
def test_limits_and_repeats_of_a_stream(spark, tmp_path, what):
    schema = "event_id long, user_id long, ts timestamp, event_type string, value double"
    rows = [(i % 7, i % 2, at(i), "click", 1.0) for i in range(14)]
    for part in (rows[:9], rows[9:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = getattr(events, what)(events.source(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName(what).outputMode("complete" if what == "allowed" else "append").option("maxFilesPerTrigger", 1).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = spark.table(what).collect()
    if what == "idempotent":
        assert sorted(r.event_id for r in got) == list(range(7))
    else:
        assert sum(r.n for r in got) == 14 and all(r.allowed == min(2, r.n) for r in got)


# --- the outbox

REQUEST = "id long, kind string, payload string, created_at timestamp"
KINDS = ("analyse", "purge")


def tasks_at(spark, path):
    from lexloom.sources import sinks

    return {r.id: (r.state, r.attempts, r.error) for r in sinks.table(spark, f"{path}/tasks", ["id"]).collect()}


def dispatcher(claimed):
    from pyspark.sql import functions as F

    bad = F.when(F.col("payload") == "bad", "Invalid payload: x").when(F.col("payload") == "flaky", "status 503")
    return claimed.withColumn("outcome", bad)


def hours(batch_id):
    from pyspark.sql import functions as F

    return F.lit(at(60 * (batch_id + 1))).cast("timestamp")


def test_claims_retries_and_dead_letters_by_batch(spark, tmp_path):
    from lexloom.streaming import outbox

    path, folder = str(tmp_path / "box"), str(tmp_path / "in")
    rows = [(1, "analyse", "ok", at(0)), (2, "analyse", "bad", at(1)), (3, "purge", "flaky", at(2)), (4, "other", "ok", at(0)), (5, "analyse", "ok", at(10_000)), (1, "analyse", "again", at(3))]
    feed = lambda some: spark.createDataFrame(some, REQUEST).coalesce(1).write.mode("append").parquet(folder)
    go = lambda: outbox.outbox(spark.readStream.schema(REQUEST).parquet(folder), path, str(tmp_path / "cp"), hours, dispatcher, KINDS).awaitTermination(180)
    feed(rows)
    go()
    first = tasks_at(spark, path)
    assert first[1][:2] == ("processed", 0) and first[2] == ("dead_letter", 1, "Invalid payload: x") and first[3] == ("retry", 1, "status 503")
    assert first[4] == ("new", 0, None) and first[5] == ("new", 0, None)
    for k in range(2, 10):  # each batch tries the flaky task once more, until its attempts are spent
        feed([(100 + k, "other", "x", at(0))])
        go()
        assert tasks_at(spark, path)[3][:2] == ("dead_letter" if k >= 8 else "retry", min(k, 8))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    from lexloom.streaming import outbox

    path = str(tmp_path / "box")
    rows = spark.createDataFrame([(i, "analyse", "flaky" if i % 2 else "ok", at(i)) for i in range(40)], REQUEST)
    turn = lambda batch: outbox.turn(rows, batch, path, hours, dispatcher, KINDS)
    turn(0)
    once = tasks_at(spark, path)
    assert sum(s == "new" for s, *_ in once.values()) == 24  # 16 were claimed
    turn(0)
    turn(0)
    assert tasks_at(spark, path) == once
    # a run that broke after its journal was written, before the table was: the journal decides, not the new state of things
    made = outbox.settled(dispatcher(outbox.claimed(outbox.due(outbox.sinks.table(spark, f"{path}/tasks", ["id"]), hours(1), KINDS), hours(1))), hours(1)).withColumn("changed_in", outbox.F.lit(1).cast("long"))
    made.write.parquet(f"{path}/journal/batch=1")
    turn(1)
    twice = tasks_at(spark, path)
    turn(1)
    assert tasks_at(spark, path) == twice and sum(s == "new" for s, *_ in twice.values()) < 24
    assert max(n for _, n, _ in twice.values()) <= 2
