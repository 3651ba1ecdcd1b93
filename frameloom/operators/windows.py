"""Training windows: offsets, sample indices with padding, chunks, evaluation blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def episode_ends(lengths: DataFrame) -> DataFrame:
    """Cumulative ends of episodes in their order. lengths: episode_id, n_frames. Runs over one row an episode, in ranges
    of episode_id whose totals are shifted, so no task holds them all."""
    ranged = lengths.withColumn("_b", F.floor(F.col("episode_id") / 1_000_000))
    sums = ranged.groupBy("_b").agg(F.sum("n_frames").alias("_s"))
    shift = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    inside = F.sum("n_frames").over(Window.partitionBy("_b").orderBy("episode_id").rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumn("_in", inside).join(shift, "_b")
    return out.select("episode_id", "n_frames", (F.col("_in") + F.col("_shift")).cast("bigint").alias("episode_end"))


def sample_indices(ends: DataFrame, pred: int, obs: int, act: int) -> DataFrame:
    """One row a sample: idx (start relative to the episode, may be negative) and the four indices buffer_start,
    buffer_end, sample_start, sample_end. Needs obs and act not above pred."""
    if not (1 <= obs <= pred and 1 <= act <= pred):
        raise ValueError("obs and act must lie in 1..pred")
    low, high = -(obs - 1), F.col("n_frames") - pred + (act - 1)
    start = F.col("episode_end") - F.col("n_frames")
    rows = ends.where(high >= low).select("episode_id", "n_frames", start.alias("base"), F.explode(F.sequence(F.lit(low).cast("bigint"), high.cast("bigint"))).alias("idx"))
    first, last = F.greatest(F.col("idx"), F.lit(0)), F.least(F.col("idx") + pred, F.col("n_frames"))
    return rows.select(
        "episode_id", "n_frames", "idx",
        (first + F.col("base")).alias("buffer_start"), (last + F.col("base")).alias("buffer_end"),
        (first - F.col("idx")).alias("sample_start"), (last - F.col("idx")).alias("sample_end"),
    )


def sample_windows(samples: DataFrame, frames: DataFrame, pred: int, obs: int, *values: str) -> DataFrame:
    """Each sample's steps with the frame they read (edge frames repeat outside the episode) and whether the step
    belongs to the observation. Indices are exploded, not payloads; values are joined last."""
    steps = samples.select("episode_id", "n_frames", "idx", F.explode(F.sequence(F.lit(0), F.lit(pred - 1))).alias("step"))
    frame = F.greatest(F.lit(0), F.least(F.col("idx") + F.col("step"), F.col("n_frames") - 1)).cast("bigint")
    steps = steps.select("episode_id", "idx", "step", frame.alias("frame_index"), (F.col("step") < obs).alias("observed"))
    return steps.join(frames.select("episode_id", "frame_index", *values), ["episode_id", "frame_index"])


def stacked(windows: DataFrame, value: str) -> DataFrame:
    """One row a sample with its values in step order; a window's length is fixed, so the array is small."""
    return windows.groupBy("episode_id", "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", value))), lambda s: s[value]).alias(value))


def action_chunks(frames: DataFrame, value: str, horizon: int, first: int) -> DataFrame:
    """Chunks of the next ``horizon`` values at every ``first``-th frame, of which the first ``first`` are carried out:
    episode_id, chunk_at, step, value."""
    w = Window.partitionBy("episode_id").orderBy("frame_index").rowsBetween(0, horizon - 1)
    chunks = frames.select("episode_id", "frame_index", F.collect_list(value).over(w).alias("chunk")).where(F.col("frame_index") % first == 0)
    return chunks.select("episode_id", F.col("frame_index").alias("chunk_at"), F.posexplode(F.slice("chunk", 1, first)).alias("step", "value"))


def eval_blocks(frames: DataFrame, act: int) -> DataFrame:
    """Frames that a roll-out in blocks of ``act`` covers, with their block: blocks start below n - act."""
    n = F.count(F.lit(1)).over(Window.partitionBy("episode_id"))
    block = F.floor(F.col("frame_index") / act)
    return frames.withColumn("block", block.cast("bigint")).withColumn("_n", n).where(F.col("block") * act < F.col("_n") - act).drop("_n")


def even_sample(lengths: DataFrame, k: int) -> DataFrame:
    """min(k, n) evenly spaced frames of each episode, ends included, places cut to whole numbers."""
    m = F.least(F.lit(k).cast("bigint"), F.col("n_frames"))
    rows = lengths.where("n_frames > 0").select("episode_id", "n_frames", m.alias("_m"), F.explode(F.sequence(F.lit(0).cast("bigint"), m - 1)).alias("i"))
    at = F.when(F.col("_m") > 1, F.floor(F.col("i") * (F.col("n_frames") - 1) / (F.col("_m") - 1))).otherwise(0)
    return rows.select("episode_id", "i", at.cast("bigint").alias("frame_index"))


def interpolated_path(moves: DataFrame, start: str, end: str, step: float = 0.01, most: int = 20) -> DataFrame:
    """A straight path in min(int(largest change / step), most) steps. start, end: vectors; rows need ``id``."""
    change = F.array_max(F.transform(F.zip_with(start, end, lambda a, b: b - a), lambda x: F.abs(x)))
    n = F.least(F.floor(change / step), F.lit(most)).cast("int")
    rows = moves.withColumn("_n", n).where("_n >= 1").select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("step"))
    share = F.when(F.col("_n") > 1, F.col("step") / (F.col("_n") - 1)).otherwise(0.0)
    return rows.select("id", "step", F.zip_with(start, end, lambda a, b: a + (b - a) * share).alias("point"))
