"""Motion trim: idle heads and tails of episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .episodes import by_episode, whole


def moving(frames: DataFrame, displacement: Column, threshold: float) -> DataFrame:
    """frames with ``m``: the step to the next frame is longer than the threshold. displacement: null on the last frame."""
    return frames.withColumn("m", F.coalesce(displacement > threshold, F.lit(False)))


def trim_ranges(frames: DataFrame, displacement: Column, threshold: float, run: int = 3, pad: int = 5) -> DataFrame:
    """episode_id, n, start, end, removed_head, removed_tail: what is left between the first and the last run of
    ``run`` moving steps, with ``pad`` frames on each side. Without such runs, or with one frame, all is kept."""
    w = by_episode()
    f = moving(frames, displacement, threshold).select("episode_id", "frame_index", "m", F.count(F.lit(1)).over(whole()).alias("n"))
    f = f.withColumn("all_move", F.min("m").over(w.rowsBetween(0, run - 1)))
    found = F.col("all_move") & (F.col("frame_index") + run <= F.col("n") - 1)
    per = f.groupBy("episode_id").agg(F.max("n").alias("n"), F.min(F.when(found, F.col("frame_index"))).alias("lo"), F.max(F.when(found, F.col("frame_index"))).alias("hi"))
    start = F.when(F.col("lo").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("lo") - pad))
    end = F.when(F.col("lo").isNull(), F.col("n")).otherwise(F.least(F.col("n"), F.col("hi") + run + 1 + pad))
    per = per.select("episode_id", "n", start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
    return per.withColumn("removed_head", F.col("start")).withColumn("removed_tail", F.col("n") - F.col("end"))


def trimmed(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """The frames inside their episode's range, numbered anew from 0."""
    kept = frames.join(ranges.select("episode_id", "start", "end"), "episode_id").where((F.col("frame_index") >= F.col("start")) & (F.col("frame_index") < F.col("end")))
    return kept.withColumn("frame_index", F.col("frame_index") - F.col("start")).drop("start", "end")


def trim_totals(ranges: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return ranges.agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("removed_head") + F.col("removed_tail") > 0).alias("trimmed"), total("removed_head"), total("removed_tail"))


def trimmed_rates(freqs: DataFrame, ranges: DataFrame, literal: bool = False) -> DataFrame:
    """Rates of the kept frames, renumbered, with average, highest, lowest and standard deviation of the episode.

    freqs: episode_id, step, hz. A log with one entry more than frames has an entry for the unsaved step 0, so entries
    shift by one; literal=True cuts entries by frame numbers as they are.
    """
    n = F.count(F.lit(1)).over(whole())
    shift = F.lit(0) if literal else F.when(n == F.col("n") + 1, 1).otherwise(0)
    joined = freqs.join(ranges.select("episode_id", "n", "start", "end"), "episode_id").withColumn("at", F.col("step") - shift)
    kept = joined.where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    w = whole()
    return kept.select(
        "episode_id", (F.row_number().over(by_episode("episode_id", "step")) - 1).cast("bigint").alias("step"), "hz",
        F.avg("hz").over(w).alias("avg_hz"), F.max("hz").over(w).alias("max_hz"), F.min("hz").over(w).alias("min_hz"), F.stddev_pop("hz").over(w).alias("std_hz"),
    )
