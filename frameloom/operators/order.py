"""Order-dependent operators: as-of lookups, ensembles, sessions, recurrences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.times import seconds_between

from .episodes import by_episode


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the newest right value at or before each row's time, by union and a running last: one shuffle, no range join."""
    marked = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    other = right.select(*[(F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in left.columns], F.lit(0).alias("_side"), F.col(value).alias("_value"))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return marked.unionByName(other).withColumn(f"latest_{value}", F.last("_value", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_value")


def held(x: Column) -> Column:
    """The last value seen, on frames that have none."""
    return F.last(x, ignorenulls=True).over(by_episode().rowsBetween(Window.unboundedPreceding, 0))


def moving_average(x: Column, n: int = 50) -> Column:
    return F.avg(x).over(by_episode().rowsBetween(-(n - 1), 0))


def side_by_side(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """Records of two arms on the same tick, values concatenated."""
    return left.select(*on, F.col(a).alias("_a")).join(right.select(*on, F.col(b).alias("_b")), on).select(*on, F.concat("_a", "_b").alias("both"))


def same_keys(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_keys(a)) == F.array_sort(F.map_keys(b))


def ensemble(chunks: DataFrame, tau: float = 0.5) -> DataFrame:
    """Overlapping chunks on a step: episode_id, step, and by mode avg, old, new and act (oldest first:
    z = z * tau + a * (1 - tau)). chunks: episode_id, chunk_at, values. Chunks that cover a step are few."""
    per = chunks.select("episode_id", "chunk_at", F.posexplode("values").alias("_i", "a")).withColumn("step", F.col("chunk_at") + F.col("_i"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_at", "a"))), lambda s: s["a"])
    folded = F.aggregate(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), F.element_at(ordered, 1), lambda z, a: z * tau + a * (1 - tau))
    return per.groupBy("episode_id", "step").agg(F.avg("a").alias("avg"), F.min_by("a", "chunk_at").alias("old"), F.max_by("a", "chunk_at").alias("new"), folded.alias("act"))


def repeated(actions: DataFrame) -> DataFrame:
    """ensemble() with a row for every step from an episode's first to its last: a step that no chunk covers repeats the
    last action."""
    until = F.coalesce(F.lead("step").over(by_episode(order="step")) - 1, F.col("step"))
    return actions.withColumn("_until", until).withColumn("step", F.explode(F.sequence("step", "_until"))).drop("_until")


def sessions(clicks: DataFrame, gap_seconds: float = 0.5) -> DataFrame:
    """Runs of clicks closer than the gap: session, clicks, first_ts, last_ts and outcome (2: save, 3 or more: delete)."""
    w = by_episode()
    new = F.coalesce(seconds_between(F.lag("ts").over(w), F.col("ts")) >= gap_seconds, F.lit(True))
    s = clicks.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = s.groupBy("episode_id", "session").agg(F.count(F.lit(1)).alias("clicks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.withColumn("outcome", F.when(F.col("clicks") == 2, "save").when(F.col("clicks") >= 3, "delete").otherwise("none"))


@dataclass(frozen=True)
class Gripper:
    close: float = 0.18
    open: float = 0.08
    hold: int = 30
    alpha: float = 0.35
    low: float = 0.0
    high: float = 1.0


def asymmetric_ema(rows: DataFrame, value: str, rising: float = 0.2, falling: float = 0.8) -> DataFrame:
    """state = (1 - alpha) * state + alpha * x, with one alpha for rising and one for falling values; it starts at 0."""
    return _folded(rows, value, "smooth", partial(Smooth, rising, falling))


def joint_ema(rows: DataFrame, value: str, alpha: float = 0.35) -> DataFrame:
    """alpha * x + (1 - alpha) * previous; the first value passes."""
    return _folded(rows, value, "smooth", partial(Smooth, alpha, alpha, first=None))


def force_smoothing(rows: DataFrame, value: str, smoothing: float = 0.5, release: float = 0.8) -> DataFrame:
    """Falls with one alpha, rises with another, and drops to 0 at once when the target is 0 or less."""
    return _folded(rows, value, "force", partial(Smooth, smoothing, release, snap=True))


def gripper_hysteresis(rows: DataFrame, value: str, how: Gripper = Gripper()) -> DataFrame:
    """Closes at one threshold, opens at a lower one after a hold, and smooths; between the thresholds it stays."""
    return _folded(rows, value, "gripper", partial(GripperFold, how))


class Smooth:
    """Exponential smoothing of a series that comes in parts."""

    def __init__(self, rising: float, falling: float, first: float | None = 0.0, snap: bool = False):
        self.rising, self.falling, self.now, self.snap = rising, falling, first, snap

    def __call__(self, x: np.ndarray) -> list[float]:
        out, now = [], self.now
        for v in x.tolist():
            if now is None:
                now = v
            else:
                alpha = self.falling if v < now else self.rising
                now = 0.0 if self.snap and v <= 0 else (1 - alpha) * now + alpha * v
            out.append(now)
        self.now = now
        return out


class GripperFold:
    """Hysteresis in two passes over a series that comes in parts.

    The first finds the spans in which the gripper is shut, from the places of high and low values alone: a span begins
    with a high value and ends before the first low one that is ``hold`` frames later. The second smooths towards a
    target with a floor: within a span the target is at least the value, the close threshold and the last output;
    in the dead band it is the last output; else it is the value.
    """

    def __init__(self, how: Gripper):
        self.how, self.shut_for, self.now = how, None, None

    def floors(self, x: np.ndarray) -> np.ndarray:
        """The floor of each frame's target, -inf in the dead band, NaN where the value itself is the target."""
        how = self.how
        high, low = np.flatnonzero(x >= how.close), np.flatnonzero(x <= how.open)
        floor = np.where(x <= how.open, np.nan, -np.inf)
        begin = None if self.shut_for is None else -1 - self.shut_for
        at = 0
        while True:
            if begin is None:
                k = np.searchsorted(high, at)
                if k == len(high):
                    self.shut_for = None
                    return floor
                begin = int(high[k])
                floor[begin] = np.nan
                at = begin + 1
            k = np.searchsorted(low, max(at, begin + how.hold))
            stop = int(low[k]) if k < len(low) else len(x)
            floor[at:stop] = np.maximum(x[at:stop], how.close)
            if stop == len(x):
                self.shut_for = len(x) - 1 - begin
                return floor
            floor[stop] = np.nan
            at, begin = stop + 1, None

    def __call__(self, x: np.ndarray) -> list[float]:
        how = self.how
        x = np.clip(x, how.low, how.high)
        out, now = [], self.now
        for v, floor in zip(x.tolist(), self.floors(x).tolist()):
            now = v if now is None else now
            target = v if floor != floor else max(now, floor)
            now = min(max(how.alpha * target + (1 - how.alpha) * now, how.low), how.high)
            out.append(now)
        self.now = now
        return out


def _folded(rows: DataFrame, value: str, out: str, make: Callable[[], Callable[[np.ndarray], list[float]]]) -> DataFrame:
    """A recurrence along each episode. Three columns travel; an episode streams through its task batch by batch, so no
    episode is held as a whole, however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fold = None, None
        for batch in batches:
            codes = batch.column("episode_id").dictionary_encode()
            at = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            x = batch.column("x").to_numpy(zero_copy_only=False).astype(float)
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
            made: list[float] = []
            for a, b in zip(starts, [*starts[1:], len(at)]):
                episode = (batch.column("episode_id")[int(a)].as_py(),)
                if episode != last:
                    last, fold = episode, make()
                made += fold(x[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("episode_id"), batch.column("frame_index"), pa.array(made, pa.float64())], ["episode_id", "frame_index", out])

    slim = rows.select("episode_id", "frame_index", F.col(value).cast("double").alias("x"))
    kind = dict(slim.dtypes)
    ordered = slim.repartition("episode_id").sortWithinPartitions("episode_id", "frame_index")
    return ordered.mapInArrow(run, f"episode_id {kind['episode_id']}, frame_index {kind['frame_index']}, {out} double")

