"""Streams of job events: change feed with keep-alive, throttled progress, lost heartbeats, repeats.

The order-dependent feeds are state processors: what a job needs later (its last
values, its last emission) is one small row in the engine's state store, and
silence is a timer there. Only the narrow columns a decision needs reach them.
The rows of one job and micro-batch meet in one task, so the size of a micro-batch
bounds what a busy job brings there; the batch twins in ``operators.events`` spread
one job over all tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from rowscribe import constants as K
from rowscribe.functions.text import strip
from rowscribe.operators.events import WATCHED

_CLOCK = "_clock"


def _timed(stream: DataFrame, time: str, delay_seconds: int) -> DataFrame:
    """The stream with a watermark on ``time`` (microseconds)."""
    return stream.withColumn(_CLOCK, F.timestamp_micros(F.col(time).cast("bigint"))).withWatermark(_CLOCK, f"{delay_seconds} seconds")


def _kinds(stream: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {stream.schema[n].dataType.simpleString()}" for n in names)


def _in_order(rows, names: list[str], order: list[str]) -> list[tuple]:
    """Rows of one key as tuples, by ``order``; missing values are None."""
    found = pd.concat(list(rows))[names].sort_values(order, kind="stable").astype(object)
    return list(found.where(found.notna(), None).itertuples(index=False, name=None))


def _frame(names: list[str], rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series([row[i] for row in rows], dtype=object) for i, name in enumerate(names)})


class _Keyed(StatefulProcessor):
    """A processor with one state row and at most one timer per key."""

    state = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def close(self) -> None:
        pass

    def due_at(self, micros: int | None) -> None:
        """Move the key's timer, in milliseconds of the watermark's clock."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if micros is not None:
            self.handle.registerTimer(-(-micros // 1000))


class _Feed(_Keyed):
    state = "status string, processed long, total long, current_step string, emitted long, ended boolean"

    def __init__(self, key: str, order: list[str], every: int, remember: int):
        self.key, self.order, self.every, self.remember = key, order, every, remember

    def _told(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return _frame([self.key, *self.order, "event_kind"], [(key[0], *emission) for emission in out])

    def _silence(self, emitted: int, until: int, out: list) -> int:
        while emitted + self.every <= until:
            emitted += self.every
            out.append((emitted, *[None] * (len(self.order) - 1), "keepalive"))
        return emitted

    def handleInputRows(self, key, rows, timerValues):
        before, emitted, ended, out = None, 0, False, []
        if self.held.exists():
            *before, emitted, ended = self.held.get()
        if ended:
            return
        width = len(self.order)
        for row in _in_order(rows, [*self.order, *WATCHED], self.order):
            place, now = row[:width], list(row[width:])
            if before is not None:
                emitted = self._silence(emitted, place[0], out)
            if now != before:
                out.append((*place, "snapshot" if before is None else "progress"))
                before, emitted = now, place[0]
            if now[0] in K.TERMINAL_STATUSES:
                out.append((*place, "done"))
                ended = True
                break
        self.held.update((*before, emitted, ended))
        self.due_at(place[0] + self.remember if ended else emitted + self.every)
        yield self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        *before, emitted, ended = self.held.get()
        if ended:
            self.held.clear()
            return
        out: list[tuple] = []
        emitted = self._silence(emitted, timerValues.getCurrentWatermarkInMs() * 1000, out)
        self.held.update((*before, emitted, ended))
        self.due_at(emitted + self.every)
        yield self._told(key, out)


def live_feed(
    stream: DataFrame,
    key: str,
    time: str,
    order: list[str],
    keepalive_seconds: float = K.KEEPALIVE_SECONDS,
    delay_seconds: int = 0,
    remember_seconds: float = 86_400.0,
) -> DataFrame:
    """``snapshot``, ``progress``, ``keepalive`` and ``done`` events per job, as a stream.

    ``time`` is in microseconds and leads ``order``. A job that sends nothing new
    gets a ``keepalive`` after every silence of that length, as far as the stream's
    clock has come (its greatest time less the delay); other order columns of such a
    row are null. An ended job leaves the state after ``remember_seconds``; until then
    further looks at it are ignored. Rows not newer than the clock are dropped.
    The batch twin is ``operators.events.silent_feed``.
    """
    slim = _timed(stream.select(key, *order, *[F.col(c).cast(k).alias(c) for c, k in zip(WATCHED, ("string", "bigint", "bigint", "string"), strict=True)]), time, delay_seconds)
    feed = _Feed(key, order, int(keepalive_seconds * 1_000_000), int(remember_seconds * 1_000_000))
    return slim.groupBy(key).transformWithStateInPandas(feed, f"{_kinds(slim, [key, *order])}, event_kind string", "append", "eventTime")


class _Throttle(_Keyed):
    state = "sent_time long, sent_count long, peak long"

    def __init__(self, names: list[str], time: str, order: list[str], every_rows: int, every: int):
        self.names, self.time, self.order = names, time, order
        self.every_rows, self.every = every_rows, every

    def handleInputRows(self, key, rows, timerValues):
        sent, counted, peak = self.held.get() if self.held.exists() else (None, 0, 0)
        at, done, total = (self.names.index(n) for n in (self.time, "processed", "total"))
        out = []
        for row in _in_order(rows, self.names, self.order):
            sent = row[at] if sent is None else sent
            peak = max(peak, row[done] or 0)
            finished = row[done] is not None and row[total] is not None and row[done] >= row[total]
            if finished or peak >= counted + self.every_rows or row[at] >= sent + self.every:
                out.append(row)
                sent, counted = row[at], peak
        self.held.update((sent, counted, peak))
        yield _frame(self.names, out)


def throttled_progress(
    stream: DataFrame,
    key: str,
    time: str,
    order: list[str],
    every_rows: int = K.PROGRESS_EVERY_ROWS,
    every_seconds: float = K.PROGRESS_EVERY_SECONDS,
) -> DataFrame:
    """Progress rows that are worth sending, over all batches of a stream.

    ``time`` is in microseconds and leads ``order``; rows of a job that arrive in a
    later batch count as later. The batch twin is ``operators.events.throttle``.
    """
    names = stream.columns
    throttle = _Throttle(names, time, order, every_rows, int(every_seconds * 1_000_000))
    return stream.groupBy(key).transformWithStateInPandas(throttle, _kinds(stream, names), "append", "none")


def lost_heartbeats(beats: DataFrame, key: str, time: str, lease_seconds: int = K.LEASE_SECONDS) -> DataFrame:
    """Times without a heartbeat for longer than the lease: (job, last beat, expiry).

    A run of heartbeats is one session whose gap is the lease; when the session
    is closed by the watermark, the lease has expired. Sessions are merged
    inside each task before the shuffle. For a stream with a watermark on
    ``time``; the batch twin is ``operators.events.lost_leases``.
    """
    runs = beats.groupBy(key, F.session_window(time, f"{lease_seconds} seconds").alias("run"))
    return runs.agg(F.max(time).alias("last_beat"), F.count(F.lit(1)).alias("beats")).select(
        key, F.col("run.start").alias("first_beat"), "last_beat", F.col("run.end").alias("expired_at"), "beats"
    )


ASKED, STARTED = "asked", "started"


class _Requests(_Keyed):
    state = "marked long"

    def __init__(self, key: str, time: str, lasts: int):
        self.key, self.time, self.lasts = key, time, lasts

    def handleInputRows(self, key, rows, timerValues):
        marked = self.held.get()[0] if self.held.exists() else None
        out = []
        # Of one time, "asked" sorts before "started".
        for at, kind in _in_order(rows, [self.time, "kind"], [self.time, "kind"]):
            if marked is not None and at >= marked + self.lasts:
                marked = None
            if kind == STARTED:
                marked = None
            elif kind == ASKED and marked is None:
                out.append(at)
                marked = at
        if marked is None:
            self.held.clear()
            self.due_at(None)
        else:
            self.held.update((marked,))
            self.due_at(marked + self.lasts)
        yield _frame([self.key, self.time], [(key[0], at) for at in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.held.clear()
        yield _frame([self.key, self.time], [])


def first_requests(requests: DataFrame, key: str, time: str, seconds: int = K.DEDUP_SECONDS, delay_seconds: int = 0) -> DataFrame:
    """Requests that are queued: (key, time) of each ``asked`` whose id carries no marker.

    ``requests`` has the id, ``time`` in microseconds and ``kind``: ``asked`` sets a
    marker that drops repeats, ``started`` (the job left the queue) clears it, and it
    expires after ``seconds``. Of one time, requests come before the start. Repeats at
    the same time are dropped in the tasks that read them. Requests without an id
    carry no marker, so all of them are queued.
    """
    kinds = _kinds(requests, [key, time])
    slim = requests.select(key, F.col(time), "kind").filter(F.col("kind").isin(ASKED, STARTED))
    named = F.coalesce(strip(F.col(key).cast("string")), F.lit("")) != ""
    once = slim.filter(named).mapInPandas(lambda frames: (frame.drop_duplicates() for frame in frames), f"{kinds}, kind string")
    marked = _Requests(key, time, seconds * 1_000_000)
    found = _timed(once, time, delay_seconds).groupBy(key).transformWithStateInPandas(marked, kinds, "append", "eventTime")
    return found.unionByName(slim.filter(~named & (F.col("kind") == ASKED)).select(key, time))
