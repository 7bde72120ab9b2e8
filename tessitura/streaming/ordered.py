"""Streams whose rows count in the order of their time, however micro-batches cut them: listening time, play sessions, retention.

State is kept per bucket of keys (:mod:`tessitura.streaming.buckets`). A row waits in state until the watermark has
passed it, so what comes late, but within the watermark, takes its place; a timer in event time wakes a bucket of keys
that hear nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.streaming.buckets import Bucketed, bucketed

DAY_US = 86_400_000_000


class InOrder(Bucketed):
    """A fold over a key's rows by time and id. Subclasses name their rows and result, and give ``step``.

    ``columns`` begins with ``at_us, id``. What is held of a key is its state, its waiting rows and when to wake it.
    """

    def step(self, state: tuple | None, row: tuple, found: list[tuple]) -> tuple | None:
        """The state after a row; results go to ``found``."""
        raise NotImplementedError

    def passed(self, state: tuple | None, now_us: int, found: list[tuple]) -> tuple | None:
        """The state once all rows up to ``now_us`` are in."""
        return state

    def due(self, state: tuple | None) -> int | None:
        """When ``passed`` has something to do, in microseconds."""
        return None

    def fold(self, key, state, rows, now_ms, found):
        now = now_ms * 1000
        folded, waiting, _ = state or (None, [], None)
        rows = sorted(waiting + rows, key=lambda r: r[:2])
        ready = sum(r[0] <= now for r in rows)
        for row in rows[:ready]:
            folded = self.step(folded, row, found)
        folded, rows = self.passed(folded, now, found), rows[ready:]
        wake = min([r[0] for r in rows[:1]] + [t for t in [self.due(folded)] if t is not None], default=None)
        return None if folded is None and not rows else (folded, rows, wake)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(self._rows(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance({}, timerValues.getCurrentWatermarkInMs())

    def _advance(self, new: dict, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """New rows, and the keys whose time has come."""
        states = self.held()
        new |= {k: [] for k, (_, _, wake) in states.items() if wake is not None and wake <= watermark_ms * 1000 and k not in new}
        results = self._folded(states, new, watermark_ms)
        if new:
            self.hold(states)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wake = min((w for _, _, w in states.values() if w is not None), default=None)
        if wake is not None:
            self.handle.registerTimer(max(-(-wake // 1000), watermark_ms + 1))
        if results:
            yield self.frame(results)


def timed(rows: DataFrame, delay: str, id_column: str = "event_id") -> DataFrame:
    """Rows with ``at`` as a timestamp with a watermark, ``at_us`` and ``id``; without a time they are no events and go, without an id they come first."""
    marked = rows.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay).where("at IS NOT NULL")
    return marked.withColumn("at_us", F.unix_micros("at")).withColumn("id", F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))))


def in_order(rows: DataFrame, fold: InOrder, ddl: str, delay: str, id_column: str = "event_id") -> DataFrame:
    """``fold`` over a stream with ``at`` and ``id_column``, per account."""
    marked = timed(rows, delay, id_column)
    return bucketed(marked.select("account", "at", *fold.columns), "account", fold, ddl, "EventTime")


class ListeningTime(InOrder):
    """Ticks (at, event_id, playing) to increments of the time listened: each interval that began playing counts, up to ``cap_seconds``.

    State is the last tick. A tick without ``playing`` is a heartbeat: it moves the watermark and counts for nothing.
    """

    columns = ["at_us", "id", "playing"]
    out = ["until_us", "milliseconds", "intervals"]

    def __init__(self, cap_seconds: float = 1.0) -> None:
        self.cap_seconds = cap_seconds

    def step(self, state, row, found):
        at, _, playing = row
        if playing is None:
            return state
        if state is None or state[1]:
            seconds = 0.0 if state is None else min(max((at - state[0]) / 1e6, 0.0), self.cap_seconds)
            found.append((at, int(seconds * 1000), int(state is not None)))
        return at, playing


def listening_increments(ticks: DataFrame, cap_seconds: float = 1.0, delay: str = "1 day") -> DataFrame:
    """``account, until_us, milliseconds, intervals`` of a stream of ticks (account, at, event_id, playing); their sums are the totals of the batch operator.

    An account's first tick gives a row of zeros, so that an account without an interval has its total too.
    """
    return in_order(ticks, ListeningTime(cap_seconds), "until_us long, milliseconds long, intervals long", delay)


class PlaySessions(InOrder):
    """Signals (at, event_id, signal) to one record per play: opened by ``started``, closed by the next signal or after ``idle_us``.

    A session that a new start ends has the cause source-change, one that hears nothing for ``idle_us`` ends then, as
    timeout. Null signals are heartbeats.
    """

    columns = ["at_us", "id", "signal"]
    out = ["session", "began_us", "ended_us", "cause"]

    def __init__(self, idle_us: int) -> None:
        self.idle_us = idle_us

    def step(self, state, row, found):
        at, _, signal = row
        if signal is None:
            return state
        number, began = self.passed(state, at - 1, found) or (0, None)
        if began is not None:
            found.append((number, began, at, "source-change" if signal == "started" else signal))
        return (number + 1, at) if signal == "started" else (number, None)

    def passed(self, state, now_us, found):
        if state is None or state[1] is None or state[1] + self.idle_us > now_us:
            return state
        found.append((state[0], state[1], state[1] + self.idle_us, "timeout"))
        return state[0], None

    def due(self, state):
        return None if state is None or state[1] is None else state[1] + self.idle_us


def session_records(signals: DataFrame, idle_us: int = DAY_US, delay: str = "1 day") -> DataFrame:
    """``account, session, began_us, ended_us, cause`` of a stream of signals (account, at, event_id, signal), once a play has ended."""
    return in_order(signals, PlaySessions(idle_us), "session long, began_us long, ended_us long, cause string", delay)


class Forgetting(InOrder):
    """Keeps an account's events of the ``days`` before its newest one, the last ``most`` of them; after ``days`` of silence all go, state and timer too.

    Yields how many are kept and the oldest of them whenever that changes, zero and null when the account is forgotten.
    """

    columns = ["at_us", "id", "play"]
    out = ["as_of_us", "kept", "oldest_us"]

    def __init__(self, days: int = 90, most: int = 5000) -> None:
        self.span_us, self.most = days * DAY_US, most

    def step(self, state, row, found):
        if row[2] is None:
            return state
        events = state[0] if state else []
        kept = [e for e in [*events, row] if e[0] >= row[0] - self.span_us][-self.most :]
        found[:] = [(row[0], len(kept), kept[0][0])]
        return (kept,)

    def passed(self, state, now_us, found):
        if state is None or state[0][-1][0] + self.span_us > now_us:
            return state
        found.append((state[0][-1][0] + self.span_us, 0, None))
        return None

    def due(self, state):
        return None if state is None else state[0][-1][0] + self.span_us


def remembered(events: DataFrame, days: int = 90, most: int = 5000, delay: str = "1 day") -> DataFrame:
    """``account, as_of_us, kept, oldest_us`` of a stream of events (account, at, event_id, play); the last row of an account tells what its state holds."""
    return in_order(events, Forgetting(days, most), "as_of_us long, kept int, oldest_us long", delay)
