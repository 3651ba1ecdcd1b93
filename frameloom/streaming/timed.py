"""Online operators that act when time passes, not only when a row comes: event-time timers over keyed state.

Time is the stream's watermark, so a run over recorded frames gives the same rows as the live one. A row below the watermark
is late; Spark leaves it out, so it changes no result. Streams hold the columns episode_id, ts (with a watermark) and what
an operator names; ``us`` is ts in microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from .buckets import LEAST_BUCKETS, Bucketed, bucketed, episodes_of, fields


def ms_from(us: int) -> int:
    """The first whole millisecond at or after a time: timers know no finer time."""
    return -(-us // 1000)


class Timed(Bucketed):
    """An episode's state is a tuple, beside rows held until the watermark has passed them. Each bucket has one timer: for
    the earliest time at which one of its episodes is due."""

    state_fields: StructType
    held_fields: StructType | None = None
    #: Columns of the rows, and those by which they come to an episode in order.
    rows: tuple[str, ...] = ("us",)
    order: tuple[str, ...] = ("us",)

    @property
    def kept(self) -> dict[str, StructType]:
        return {"state": self.state_fields} | ({"held": self.held_fields} if self.held_fields else {})

    def take(self, state: tuple | None, held: list[tuple], rows: Iterator[tuple]) -> tuple[tuple | None, list[tuple], list[tuple]]:
        """New rows of an episode: its state and held rows from now on, and what it gives."""
        raise NotImplementedError

    def passed(self, state: tuple | None, held: list[tuple], end: int) -> tuple[tuple | None, list[tuple], list[tuple]]:
        """The same when the watermark (``end``, in microseconds) is beyond the time at which the episode was due."""
        raise NotImplementedError

    def due(self, state: tuple | None, held: list[tuple]) -> int | None:
        """When the episode is due next, in microseconds."""
        raise NotImplementedError

    def wake(self, us: int | None) -> None:
        """One timer, at this time or not at all."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if us is not None:
            self.handle.registerTimer(ms_from(us))

    def _opened(self) -> tuple[dict, dict]:
        states = {episode: state for episode, (state,) in self.load("state").items()}
        return states, self.load("held") if self.held_fields else {}

    def _closed(self, states: dict, helds: dict) -> None:
        self.store("state", {episode: [state] for episode, state in states.items() if state is not None})
        if self.held_fields:
            self.store("held", helds)
        times = (self.due(states.get(episode), helds.get(episode, [])) for episode in {**states, **helds})
        first = min((t for t in times if t is not None), default=None)
        self.wake(None if first is None else first + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (states, helds), out = self._opened(), []
        for episode, *columns in episodes_of(rows, list(self.order), list(self.rows)):
            states[episode], helds[episode], given = self.take(states.get(episode), helds.get(episode, []), zip(*columns))
            out += [(episode, *row) for row in given]
        self._closed(states, helds)
        yield from self.result(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (states, helds), out, end = self._opened(), [], timerValues.getCurrentWatermarkInMs() * 1000
        for episode in {**states, **helds}:
            state, held = states.get(episode), helds.get(episode, [])
            if (at := self.due(state, held)) is not None and at < end:
                states[episode], helds[episode], given = self.passed(state, held, end)
                out += [(episode, *row) for row in given]
        self._closed(states, helds)
        yield from self.result(key, out)


class Ticks(Timed):
    """The newest action at each tick, the last one again where nothing has come since. A tick is given once the watermark is
    beyond it; the first is at or after a key's first action. every: microseconds between ticks.

    Rows: episode_id, ts, us, x. Null actions are no actions."""

    state_fields = fields(next=LongType, last=DoubleType)
    held_fields = fields(us=LongType, x=DoubleType)
    out = fields(episode_id=LongType, us=LongType, action=DoubleType)
    rows = ("us", "x")

    def __init__(self, every: int):
        self.every = every

    def take(self, state, held, rows):
        new = [(t, x) for t, x in rows if x is not None and x == x]
        if new:
            held = sorted(held + new)
            first = -(-held[0][0] // self.every) * self.every
            if state is None:
                state = (first, float("nan"))
            elif state[1] != state[1]:  # no tick given yet: an earlier first action may still come
                state = (min(state[0], first), float("nan"))
        return state, held, []

    def passed(self, state, held, end):
        tick, last = state
        at, out = 0, []
        while tick < end:
            while at < len(held) and held[at][0] <= tick:
                last = held[at][1]
                at += 1
            out.append((tick, last))
            tick += self.every
        return (tick, last), held[at:], out

    def due(self, state, held):
        return state and state[0]


class Clicks(Timed):
    """Runs of clicks with gaps strictly below ``gap`` microseconds. A third click deletes at once and begins anew; two
    clicks save once nothing has come for the gap; one means nothing.

    Rows: episode_id, ts, us. A click that is older than the last one counted counts at that one's time. Outcomes:
    episode_id, first_us, us (of the last click), outcome."""

    state_fields = fields(clicks=LongType, first=LongType, last=LongType)
    out = fields(episode_id=LongType, first_us=LongType, us=LongType, outcome=StringType)

    def __init__(self, gap: int):
        self.gap = gap

    def take(self, state, held, rows):
        clicks, first, last = state or (0, 0, 0)
        out = []
        for (t,) in rows:
            if clicks and t - last >= self.gap:
                if clicks == 2:
                    out.append((first, last, "save"))
                clicks = 0
            first = first if clicks else t
            last = max(t, last) if clicks else t
            clicks += 1
            if clicks == 3:
                out.append((first, last, "delete"))
                clicks = 0
        return (clicks, first, last) if clicks else None, held, out

    def passed(self, state, held, end):
        clicks, first, last = state
        return None, held, [(first, last, "save")] if clicks == 2 else []

    def due(self, state, held):
        return state and state[2] + self.gap


class Latest(Timed):
    """For each request the newest value at or before its time, null if there is none: two streams as one. A request is
    answered once the watermark is beyond its time, so that a value that comes later in the table but earlier in time counts.

    Rows: episode_id, ts, us, id (null: a value and no request), x. Of values of one time the greatest counts."""

    state_fields = fields(us=LongType, x=DoubleType)
    held_fields = fields(us=LongType, id=LongType, x=DoubleType)
    out = fields(episode_id=LongType, id=LongType, us=LongType, x=DoubleType)
    rows = ("us", "id", "x")

    def take(self, state, held, rows):
        return state, held + [(t, -1 if i is None or i != i else int(i), float("nan") if x is None else x) for t, i, x in rows], []

    def passed(self, state, held, end):
        at, value = state or (None, None)
        out = []
        for t, i, x in sorted((r for r in held if r[0] < end), key=lambda r: (r[0], r[1] >= 0, r[2])):
            if i < 0:
                at, value = t, x
            else:
                out.append((i, t, value))
        return None if at is None else (at, value), [r for r in held if r[0] >= end], out

    def due(self, state, held):
        return min((t for t, *_ in held), default=None)


class Tracked(Timed):
    """A recurrence that forgets: its state is cleared where nothing has come for more than ``lost`` microseconds, so a
    stream that is found again starts anew. start and step as for Fold.

    Rows: episode_id, ts, us, frame_index, x. State of streams that stay lost goes by a timer."""

    state_fields = fields(last=LongType, a=DoubleType, b=DoubleType)
    out = fields(episode_id=LongType, frame_index=LongType, y=DoubleType)
    rows = ("us", "frame_index", "x")
    order = ("us", "frame_index")

    def __init__(self, lost: int, start: tuple[float, float], step):
        self.lost, self.start, self.step = lost, start, step

    def take(self, state, held, rows):
        last, *now = state or (None, *self.start)
        out = []
        for t, i, x in rows:
            if last is not None and t - last > self.lost:
                now = self.start
            now, y = self.step(tuple(now), x)
            last = t
            out.append((i, y))
        return (last, *now), held, out

    def passed(self, state, held, end):
        return None, held, []

    def due(self, state, held):
        return state and state[0] + self.lost


def timed(stream: DataFrame, processor: Timed, buckets: int = LEAST_BUCKETS) -> DataFrame:
    """The rows of a timed operator over a stream with a watermark on ts."""
    return bucketed(stream.withColumn("us", F.unix_micros("ts")), processor, buckets, "EventTime")


def without_recordings(frames: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Frames (episode_id, us, ...) outside the recordings that were deleted. Recordings of an episode don't overlap, so the
    newest one that began at or before a frame decides: one shuffle, no range join."""
    gone = outcomes.where("outcome = 'delete'").select("episode_id", F.col("first_us").alias("us"), F.col("us").alias("_until"))
    both = frames.withColumns({"_until": F.lit(None).cast("bigint"), "_frame": F.lit(1)}).unionByName(gone.withColumn("_frame", F.lit(0)), allowMissingColumns=True)
    until = F.last("_until", ignorenulls=True).over(Window.partitionBy("episode_id").orderBy("us", "_frame").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_last", until).where("_frame = 1 and (_last is null or us > _last)").drop("_until", "_frame", "_last")
