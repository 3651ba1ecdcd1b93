"""Streaming forms of the online operators. Keyed state lives in the state store; nothing is kept in Python between batches. Its
keys are buckets of episodes (buckets.py).

transformWithStateInPandas needs the RocksDB state store; run() sets it for the query and puts the setting back.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from frameloom.operators.order import Gripper

from .buckets import LEAST_BUCKETS, Bucketed, bucketed, episodes_of, fields

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "false",
}


def run(stream: DataFrame, mode: str, folder: str, stops: int | None = None) -> DataFrame:
    """Runs a stream over all that is there now and gives its rows with the number of their batch; in update mode the last
    of each batch count. stops: end the query after so many batches first and start it again on its checkpoint. Batches
    are written under their number, so one that runs again replaces itself."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    out = f"{folder}/{uuid.uuid4().hex}"
    schema = stream.schema
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        done.append(number)

    def start():
        return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").foreachBatch(keep).start()

    try:
        if stops:
            query = start()
            while len(done) < stops and query.isActive:
                time.sleep(0.05)
            query.stop()
        query = start()
        query.processAllAvailable()
        query.stop()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{out}/rows")


def newest_per_key(stream: DataFrame, key: str, time: str, *values: str) -> DataFrame:
    """Only the newest observation of each key: what draining a queue leaves."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*values), F.col(time)).alias("_o"), F.max(time).alias(time)).select(key, time, "_o.*")


def appended(stream: DataFrame) -> DataFrame:
    """Frames to append to a table; the first of an episode isn't saved."""
    return stream.where("frame_index > 0")


class Fold(Bucketed):
    """A recurrence for each key: state and result from state and value. Rows with ``reset`` clear the state first."""

    out = fields(episode_id=LongType, frame_index=LongType, y=DoubleType)

    def __init__(self, start: tuple[float, ...], step: Callable[[tuple[float, ...], float], tuple[tuple[float, ...], float]]):
        self.start, self.step = start, step
        self.kept = {"state": fields(**{f"s{i}": DoubleType for i in range(len(start))})}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        states, out = self.load("state"), []
        for episode, frames, xs, resets in episodes_of(rows, ["frame_index"], ["frame_index", "x", "reset"]):
            (state,) = states.get(episode, [self.start])
            for i, x, reset in zip(frames, xs, resets):
                state, y = self.step(self.start if reset else state, x)
                out.append((episode, i, y))
            states[episode] = [state]
        self.store("state", states)
        yield from self.result(key, out)


def folded(stream: DataFrame, processor: Fold, buckets: int = LEAST_BUCKETS) -> DataFrame:
    """stream: episode_id, frame_index, x, reset."""
    return bucketed(stream, processor, buckets, "none")


def ema_step(rising: float = 0.2, falling: float = 0.8):
    def step(state, x):
        alpha = falling if x < state[0] else rising
        now = (1 - alpha) * state[0] + alpha * x
        return (now,), now

    return step


def force_step(smoothing: float = 0.5, release: float = 0.8):
    def step(state, x):
        alpha = release if x < state[0] else smoothing
        now = 0.0 if x <= 0 else (1 - alpha) * state[0] + alpha * x
        return (now,), now

    return step


def edge_step(threshold: float = 0.5):
    """1 where the value reaches the threshold from below. State starts at the threshold, so a first value is no edge."""
    return lambda state, x: ((x,), 1.0 if state[0] < threshold <= x else 0.0)


def reference_step():
    """Difference from the first value since the start or the last reset."""
    def step(state, x):
        first = x if state[1] == 0.0 else state[0]
        return (first, 1.0), x - first

    return step


def gripper_step(how: Gripper = Gripper()):
    """Hysteresis for each value: shut from the close threshold on, open at the open threshold once it was shut for the
    hold; the output is smoothed towards the value, or towards the last output where neither threshold speaks. State:
    shut, frames since, output (NaN before the first value)."""

    def step(state, x):
        shut, since, now = state
        x = min(max(x, how.low), how.high)
        if now != now:
            return (float(x >= how.close), 0.0, x), x
        if shut and (x > how.open or since + 1 < how.hold):
            since, target = since + 1, max(now, x, how.close)
        else:
            target = x if shut or x >= how.close or x <= how.open else now
            shut, since = float(not shut and x >= how.close), 0.0
        now = min(max(how.alpha * target + (1 - how.alpha) * now, how.low), how.high)
        return (shut, since, now), now

    return step


class ChunkQueue(Bucketed):
    """Action chunks that arrive late and overlap: stale heads are dropped, equal steps are gathered, at most ``most``
    steps are held. Each tick gives the action for its step in one of the modes act, avg, old, new, or the last one again.

    Rows: episode_id, t (tick), chunk_t (step of the chunk's first action, null for a mere tick), values.
    """

    kept = {"queue": fields(t=LongType, nth=LongType, a=DoubleType), "last": fields(a=DoubleType)}
    out = fields(episode_id=LongType, t=LongType, action=DoubleType)

    def __init__(self, mode: str = "act", tau: float = 0.5, most: int = 32):
        self.mode, self.tau, self.most = mode, tau, most

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        queues, lasts, out = self.load("queue"), self.load("last"), []
        for episode, ts, chunk_ts, chunks in episodes_of(rows, ["t", "chunk_t"], ["t", "chunk_t", "values"]):
            held: dict[int, list[float]] = {}
            for t, _, a in sorted(queues.get(episode, ())):
                held.setdefault(t, []).append(a)
            last = lasts[episode][0][0] if episode in lasts else None
            at = 0
            while at < len(ts):
                t = ts[at]
                held = {k: v for k, v in held.items() if k >= t}
                while at < len(ts) and ts[at] == t:
                    chunk_t, values = chunk_ts[at], chunks[at]
                    if chunk_t == chunk_t and values is not None:
                        for i, a in enumerate(values):
                            if chunk_t + i >= t:
                                held.setdefault(int(chunk_t) + i, []).append(float(a))
                    at += 1
                held = dict(sorted(held.items())[: self.most])
                if (found := held.pop(t, None)) is not None:
                    last = self.chosen(found)
                out.append((episode, t, last))
            queues[episode] = [(t, i, a) for t, found in sorted(held.items()) for i, a in enumerate(found)]
            if last is not None:
                lasts[episode] = [(last,)]
        self.store("queue", queues)
        self.store("last", lasts)
        yield from self.result(key, out)

    def chosen(self, found: list[float]) -> float:
        if self.mode == "avg":
            return sum(found) / len(found)
        if self.mode in ("old", "new"):
            return found[0 if self.mode == "old" else -1]
        z = found[0]
        for a in found[1:]:
            z = z * self.tau + a * (1 - self.tau)
        return z


def chunk_actions(stream: DataFrame, queue: ChunkQueue, buckets: int = LEAST_BUCKETS) -> DataFrame:
    return bucketed(stream, queue, buckets, "none")
