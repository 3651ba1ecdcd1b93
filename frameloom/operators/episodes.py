"""Episode catalogue: frames, totals, durations, listings.

frames have episode_id, frame_index (0-based, unique in an episode) and ts; other columns ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.text import EXCLUDED_ENDINGS, is_excluded, natural_key, starts_with_any
from frameloom.functions.times import seconds_between


def by_episode(episode: str = "episode_id", order: str = "frame_index"):
    """The window that all order-dependent operators share, so that one exchange and one sort serve a chain of them."""
    return Window.partitionBy(episode).orderBy(order)


def whole(episode: str = "episode_id"):
    return Window.partitionBy(episode)


def small(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """rows with a broadcast hint if they are few; otherwise the planner chooses another way."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def numbered(rows: DataFrame, episode: str, order: list) -> DataFrame:
    """rows with frame_index; order must be unique within an episode."""
    return rows.withColumn("frame_index", F.row_number().over(Window.partitionBy(episode).orderBy(*order)).cast("bigint") - 1)


def episode_lengths(frames: DataFrame) -> DataFrame:
    """One row an episode: n_frames, first_ts, last_ts, seconds."""
    out = frames.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_frames"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.withColumn("seconds", seconds_between(F.col("first_ts"), F.col("last_ts")))


def duration(seconds: Column, frames: Column, fps: Column, default_fps: float = 30.0) -> tuple[Column, Column]:
    """Seconds of an episode and where they come from: times if they don't run backwards, else frames over a rate."""
    from_rate, from_default = frames / fps, frames / F.lit(default_fps)
    timed = seconds >= 0
    rated = fps > 0
    value = F.when(timed, seconds).when(rated, from_rate).otherwise(from_default)
    return value, F.when(timed, "timestamps").when(rated, "average_fps").otherwise("default_fps")


def dataset_totals(episodes: DataFrame) -> DataFrame:
    """One row: episodes, frames, seconds and averages; zeros when there is nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = F.count(F.lit(1))
    return episodes.agg(
        n.alias("episodes"),
        zero(F.sum("n_frames")).cast("bigint").alias("frames"),
        zero(F.sum("seconds")).cast("double").alias("seconds"),
        zero(F.avg("n_frames")).cast("double").alias("avg_frames"),
        zero(F.avg("seconds")).cast("double").alias("avg_seconds"),
    )


def task_rollup(rows: DataFrame, task: str, demo: str) -> DataFrame:
    """Frames for each demo, for each task and for all, in one pass."""
    return rows.rollup(task, demo).agg(F.count(F.lit(1)).alias("n_frames"), F.grouping_id().cast("int").alias("level"))


def list_episodes(paths: DataFrame, name: str = "name", prefixes: str | None = None, endings: tuple[str, ...] = EXCLUDED_ENDINGS) -> DataFrame:
    """Paths whose name has a wanted prefix and no excluded ending, with their natural sort key."""
    kept = paths.where(~is_excluded(F.col(name), endings)).where(starts_with_any(F.col(name), F.lit(prefixes)))
    return kept.withColumn("sort_key", natural_key(F.col(name)))


def demo_directories(files: DataFrame) -> DataFrame:
    """Directories that hold pickles and aren't excluded; if a root has none, the root itself. files: root, dir, file."""
    held = files.where(F.col("file").endswith(".pkl"))
    demos = held.where((F.col("dir") != "") & ~is_excluded(F.col("dir"))).select("root", "dir").distinct()
    roots = held.where(F.col("dir") == "").select("root", "dir").distinct().join(demos.select("root").distinct(), "root", "left_anti")
    return demos.unionByName(roots)


def newest(rows: DataFrame, time: str, name: str, n: int) -> DataFrame:
    """The n newest; equal times by name."""
    return rows.orderBy(F.desc(time), F.asc(name)).limit(n)


def limit_then_filter(rows: DataFrame, root: str, name: str, k: int, valid: Column) -> DataFrame:
    """The first k of each root by name, and of those the valid ones."""
    rank = F.row_number().over(Window.partitionBy(root).orderBy(name))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank").where(valid)


def first_value_of(frames: DataFrame, column: str) -> DataFrame:
    """The first frame's value for each episode."""
    return frames.groupBy("episode_id").agg(F.min_by(column, "frame_index").alias(column))


def before_first_gap(frames: DataFrame, column: str) -> DataFrame:
    """Frames before the first null of a series; an episode that starts with null has none."""
    gap = F.min(F.when(F.col(column).isNull(), F.col("frame_index"))).over(whole())
    return frames.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("frame_index") < F.col("_gap"))).drop("_gap")


def resolved(row_columns: list[str], aliases: list[str]) -> Column:
    """The first alias that the table has (a dotted path reads a field); null literal if there is none."""
    for alias in aliases:
        if alias.split(".")[0] in row_columns:
            return F.col(alias)
    return F.lit(None)


def streams_of(frames: DataFrame, key: str, cameras: str) -> DataFrame:
    """One row for each camera of a multi-camera field, named key or key_i when there are several."""
    out = frames.select("*", F.posexplode(cameras).alias("camera_index", "payload"))
    name = F.when(F.size(cameras) > 1, F.concat_ws("_", F.lit(key), F.col("camera_index"))).otherwise(F.lit(key))
    return out.withColumn("stream", name).drop(cameras)
