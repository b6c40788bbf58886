"""Keyed state over event streams: sessions with an explicit end, quotas by anchored period, a watchdog of stale jobs.

Rows wait in a key's state until the watermark has passed them and are then folded in the order of their time, so the results
do not depend on how rows were dealt to micro-batches: they equal those of the sorted table. A key's deadline is an event-time
timer; when the watermark passes it, the key's state expires and is removed. Rows later than the watermark are left out.

A state store that can hold timers is needed: `configured` sets RocksDB's.
"""

from __future__ import annotations

import calendar
import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds after which a queued or a running job is stale, and how often it is sent again.
STALE = {"queued": 10 * 60_000, "running": 45 * 60_000}
REQUEUES = 5


def configured(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Ordered(StatefulProcessor):
    """Folds a key's rows in order of (at, id). Subclasses say what a row, and a passed deadline, make of the state (a tuple, None
    for none) and which rows come out of it."""

    #: Columns of rows besides `at` (milliseconds) and `id`, of the state, and of what comes out after the key.
    FIELDS, STATE, OUT = "", "", ""

    def step(self, key: tuple, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def deadline(self, state: tuple) -> int:
        raise NotImplementedError

    def expire(self, key: tuple, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", f"at long, id long, {self.FIELDS}")
        self.held = handle.getValueState("held", self.STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = ["at", "id", *(x.split()[0] for x in self.FIELDS.split(", "))]
        new = [tuple(None if pd.isna(v) else getattr(v, "item", lambda v=v: v)() for v in row) for g in rows for row in g[names].itertuples(index=False)]
        self.pending.appendList(new)
        self.handle.registerTimer(min(r[0] for r in new))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.pending.get()]
        state, out = self.folded(key, tuple(self.held.get()) if self.held.exists() else None, sorted(r for r in waiting if r[0] <= upto), upto)
        later = [r for r in waiting if r[0] > upto]
        if later:
            self.pending.put(later)
            self.handle.registerTimer(min(r[0] for r in later))
        else:
            self.pending.clear()
        if state is None:
            self.held.clear()
        else:
            self.held.update(state)
            self.handle.registerTimer(self.deadline(state))
        if out:
            yield pd.DataFrame(out, columns=self.columns(key))

    def folded(self, key: tuple, state: tuple | None, rows: list[tuple], upto: int) -> tuple[tuple | None, list[tuple]]:
        out: list[tuple] = []
        for row in [*rows, None]:
            until = upto if row is None else row[0]
            while state is not None and self.deadline(state) <= until:
                state, made = self.expire(key, state, self.deadline(state))
                out += made
            if row is not None:
                state, made = self.step(key, state, row)
                out += made
        return state, [(*key, *r) for r in out]

    def columns(self, key: tuple) -> list[str]:
        return [*(f"key_{i}" for i in range(len(key))), *(x.split()[0] for x in self.OUT.split(", "))]


class Sessions(Ordered):
    """A session begins, gathers text, changes its status, and ends; one that is idle too long expires. What comes without a begun
    session is left out; a second begin starts anew."""

    FIELDS, STATE = "kind string, text string", "gathered string, status string, started long, last long, n long"
    OUT = "outcome string, gathered string, status string, started long, ended long, n long"

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def step(self, key, state, row):
        at, _, kind, text = row
        if kind == "begin":
            return ("", None, at, at, 0), []
        if state is None:
            return None, []
        gathered, status, started, _, n = state
        if kind == "end":
            return None, [("ended", gathered, status, started, at, n)]
        if kind == "status":
            return (gathered, text, started, at, n), []
        return (gathered + (text or ""), status, started, at, n + 1), []

    def deadline(self, state):
        return state[3] + self.idle

    def expire(self, key, state, at):
        gathered, status, started, _, n = state
        return None, [("expired", gathered, status, started, at, n)]


def month_on(anchor: int, k: int) -> int:
    """The instant k months after an anchor (milliseconds, UTC): the anchor's day, or the month's last, at its time of day."""
    a = datetime.datetime.fromtimestamp(anchor / 1000, datetime.UTC)
    year, month = divmod(a.year * 12 + a.month - 1 + k, 12)
    day = min(a.day, calendar.monthrange(year, month + 1)[1])
    whole = datetime.datetime(year, month + 1, day, tzinfo=datetime.UTC).timestamp() * 1000
    return int(whole) + (((a.hour * 60 + a.minute) * 60 + a.second) * 1000 + anchor % 1000)


def period_of(anchor: int, at: int) -> int:
    """Which of the anchor's months an instant falls in, from 0."""
    a, t = (datetime.datetime.fromtimestamp(x / 1000, datetime.UTC) for x in (anchor, at))
    k = (t.year - a.year) * 12 + t.month - a.month
    return k if month_on(anchor, k) <= at else k - 1


class Quotas(Ordered):
    """Uses of two kinds by months from an anchor (milliseconds), which each row brings along: each closed month with uses comes
    out, and its state goes."""

    FIELDS, STATE = "kind string, anchor long", "anchor long, period long, pro long, lite long"
    OUT = "period_start long, period_end long, pro long, lite long"

    def step(self, key, state, row):
        at, _, kind, anchor = row
        anchor, period, pro, lite = state or (anchor, period_of(anchor, at), 0, 0)
        return (anchor, period, pro + (kind == "pro"), lite + (kind == "lite")), []

    def deadline(self, state):
        return month_on(state[0], state[1] + 1)

    def expire(self, key, state, at):
        anchor, period, pro, lite = state
        return None, [(month_on(anchor, period), at, pro, lite)]


class Watchdog(Ordered):
    """Jobs that stay queued or running too long: sent again, each time queued anew, until the budget is spent; then failed."""

    FIELDS, STATE, OUT = "state string", "state string, since long, requeues long", "action string, was string, at long, requeues long"

    def step(self, key, state, row):
        at, _, kind = row
        return (None if kind not in STALE else (kind, at, state[2] if state else 0)), []

    def deadline(self, state):
        return state[1] + STALE[state[0]]

    def expire(self, key, state, at):
        was, _, requeues = state
        if requeues >= REQUEUES:
            return None, [("fail", was, at, requeues)]
        return ("queued", at, requeues + 1), [("requeue", was, at, requeues + 1)]


def stateful(events: DataFrame, key: list[str], processor: Ordered, late: str = "10 minutes") -> DataFrame:
    """The rows that a processor makes of a stream with the key's columns, ts, id and the processor's fields; its key columns
    are named as in `events`. `ts` is the event time."""
    kinds = dict(events.dtypes)
    fields = [x.split()[0] for x in processor.FIELDS.split(", ")]
    timed = events.withWatermark("ts", late)
    rows = timed.selectExpr(*(f"`{k}` AS key_{i}" for i, k in enumerate(key)), "ts", "unix_millis(ts) AS at", "id", *fields)
    out = ", ".join([*(f"key_{i} {kinds[k]}" for i, k in enumerate(key)), processor.OUT])
    made = rows.groupBy(*(f"key_{i}" for i in range(len(key)))).transformWithStateInPandas(processor, out, "Append", "EventTime")
    return made.withColumnsRenamed({f"key_{i}": k for i, k in enumerate(key)})
