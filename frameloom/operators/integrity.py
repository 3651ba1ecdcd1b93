"""Integrity rules. Each gives rows episode_id, severity, code, detail; an episode without issues is fine, warnings don't count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.times import seconds_between

from .episodes import by_episode, small


def issue(rows: DataFrame, when: Column, severity: str, code: str, detail: Column) -> DataFrame:
    return rows.where(when).select("episode_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))


def gathered(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def frame_count_rule(episodes: DataFrame) -> DataFrame:
    """IC1: a frame count that is missing or not above 0."""
    return issue(episodes, F.col("frame_count_attr").isNull() | (F.col("frame_count_attr") <= 0), "issue", "frame_count", F.coalesce(F.col("frame_count_attr").cast("string"), F.lit("missing")))


def video_rate_rule(episodes: DataFrame) -> DataFrame:
    """IC2: a video rate that isn't a finite number above 0."""
    bad = F.isnan("video_fps") | (F.abs("video_fps") == F.lit(float("inf"))) | (F.col("video_fps") <= 0)
    return issue(episodes, F.coalesce(bad, F.lit(True)), "warning", "video_fps", F.coalesce(F.col("video_fps").cast("string"), F.lit("missing")))


def timestamp_rules(times: DataFrame, episodes: DataFrame, show: int = 5) -> DataFrame:
    """IC3: no times, another number of them than frames, or unreadable ones (the first few). times: episode_id, frame_index, raw."""
    per = times.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), first_of(F.when(F.try_to_timestamp("raw").isNull(), F.col("frame_index")), show).alias("bad"))
    joined = episodes.select("episode_id", "frame_count_attr").join(per, "episode_id", "left")
    return gathered(
        issue(joined, F.col("n").isNull(), "issue", "timestamps_missing", F.lit("")),
        issue(joined, F.col("n") != F.col("frame_count_attr"), "issue", "timestamps_length", F.col("n")),
        issue(joined, F.size("bad") > 0, "issue", "timestamps_unreadable", F.array_join(F.transform("bad", lambda x: x.cast("string")), ",")),
    )


def steps(frames: DataFrame) -> DataFrame:
    """frames with dt, the seconds since the frame before (null on the first)."""
    return frames.withColumn("dt", seconds_between(F.lag("ts").over(by_episode()), F.col("ts")))


def first_of(value: Column, k: int) -> Column:
    """The k smallest values as a sorted array. Lists of violations are short beside the data; use on those only."""
    return F.slice(F.array_sort(F.collect_list(value)), 1, k)


def not_increasing(rows: DataFrame, order: str, value: str, show: int = 10) -> DataFrame:
    """IC4: episode_id, n_violations, first (places of the later rows) and n_more, where value doesn't grow."""
    later = rows.withColumn("_bad", F.col(value) <= F.lag(value).over(by_episode("episode_id", order)))
    bad = later.where("_bad")
    nth = F.row_number().over(Window.partitionBy("episode_id").orderBy(order))
    return bad.withColumn("_nth", nth).groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n_violations"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_nth") <= show, F.col(order)))), lambda x: x.cast("string")), ",").alias("first"),
        F.greatest(F.count(F.lit(1)) - show, F.lit(0)).alias("n_more"),
    )


def gap_warnings(frames: DataFrame, least: float = 1.0, times: float = 5.0) -> DataFrame:
    """IC5: episode_id, max_dt, avg_dt where the largest step is above max(least, times * average)."""
    per = steps(frames).groupBy("episode_id").agg(F.max("dt").alias("max_dt"), F.avg("dt").alias("avg_dt"))
    return per.where((F.col("avg_dt") > 0) & (F.col("max_dt") > F.greatest(F.lit(least), F.col("avg_dt") * times)))


def length_mismatches(lengths: DataFrame) -> DataFrame:
    """IC6: fields whose length isn't the frame count. lengths: episode_id, frame_count_attr, lengths (map<string, bigint>)."""
    wrong = F.map_filter("lengths", lambda k, v: v != F.col("frame_count_attr"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(wrong), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return issue(lengths, F.size(wrong) > 0, "issue", "length_mismatch", text)


def not_finite_counts(rows: DataFrame, vector: str) -> DataFrame:
    """IC7: episode_id and the number of NaN or infinite elements of its vectors."""
    bad = F.size(F.filter(vector, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    return rows.groupBy("episode_id").agg(F.coalesce(F.sum(bad), F.lit(0)).cast("bigint").alias("n_bad"))


def missing_streams(present: DataFrame, expected: DataFrame) -> DataFrame:
    """IC8: episode_id and stream pairs that should be there. expected: stream, a short list, repeated for each episode."""
    grid = present.select("episode_id").distinct().join(small(expected), how="cross")
    return grid.join(present.select("episode_id", "stream").distinct(), ["episode_id", "stream"], "left_anti")


def stream_rules(streams: DataFrame) -> DataFrame:
    """IC9: streams that are empty (issue) or lack sensible attributes (warning)."""
    odd = (F.coalesce("fps", F.lit(0.0)) <= 0) | (F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0)
    return gathered(issue(streams, F.coalesce("n_bytes", F.lit(0)) <= 0, "issue", "stream_empty", F.col("stream")), issue(streams, odd, "warning", "stream_attributes", F.col("stream")))


def decoded_count_rule(counts: DataFrame, tolerance: int = 0) -> DataFrame:
    """IC10: decoded frames off by more than the tolerance. counts: episode_id, stream, frame_count_attr, n_decoded."""
    return issue(counts, F.abs(F.col("n_decoded") - F.col("frame_count_attr")) > tolerance, "issue", "decoded_count", F.concat_ws("=", "stream", "n_decoded"))


def rate_log_rule(counts: DataFrame) -> DataFrame:
    """IC11: rate logs with neither as many entries as frames nor one more. counts: episode_id, frame_count_attr, n_rates."""
    return issue(counts, ~F.col("n_rates").isin(0) & (F.col("n_rates") != F.col("frame_count_attr")) & (F.col("n_rates") != F.col("frame_count_attr") + 1), "warning", "rate_log", F.col("n_rates"))


def unreadable_rule(files: DataFrame) -> DataFrame:
    """IC12: files that can't be read, or hold nothing. files: episode_id, error (null if read), n_bytes."""
    return gathered(issue(files, F.col("error").isNotNull(), "issue", "unreadable", F.col("error")), issue(files, F.col("error").isNull() & (F.coalesce("n_bytes", F.lit(0)) == 0), "issue", "empty", F.lit("")))


def series_rule(lengths: DataFrame) -> DataFrame:
    """IC13: state, action, gripper and tactile as long as the times. lengths: episode_id, n_times, n_state, n_action, n_gripper, n_tactile (null if absent)."""
    return gathered(*[issue(lengths, F.col(f"n_{c}") != F.col("n_times"), "error", f"{c}_length", F.col(f"n_{c}")) for c in ("state", "action", "gripper", "tactile")])


def integrity_summary(episodes: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: checked, ok, bad (with issues or errors), warned, frames. episodes: episode_id, n_frames."""
    marks = issues.groupBy("episode_id").agg(F.bool_or(F.col("severity") != "warning").alias("bad"), F.bool_or(F.col("severity") == "warning").alias("warned"))
    joined = episodes.join(marks, "episode_id", "left")
    bad = F.coalesce("bad", F.lit(False))
    return joined.agg(F.count(F.lit(1)).alias("checked"), F.count_if(~bad).alias("ok"), F.count_if(bad).alias("bad"), F.count_if(F.coalesce("warned", F.lit(False))).alias("warned"), F.coalesce(F.sum("n_frames"), F.lit(0)).cast("bigint").alias("frames"))


def distinct_counts(counts: DataFrame, value: str) -> DataFrame:
    """AG12: the distinct values of each episode, sorted. The number of distinct values must be small."""
    return counts.groupBy("episode_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(value)), lambda x: x.cast("string")), ",").alias("values"))


def timestep_report(frames: DataFrame, drop_factor: float = 2.5) -> DataFrame:
    """AG8: mean rate over positive steps, smallest and largest step, repeated times, and steps above drop_factor medians."""
    dt = steps(frames).where("dt is not null").select("episode_id", "dt")
    positive = F.when(F.col("dt") > 0, F.col("dt"))
    median = dt.groupBy("episode_id").agg(F.median(positive).alias("median_dt"))
    joined = dt.join(median, "episode_id")
    return joined.groupBy("episode_id").agg(
        (F.lit(1.0) / F.avg(positive)).alias("mean_hz"),
        F.min("dt").alias("min_dt"),
        F.max("dt").alias("max_dt"),
        F.count_if(F.col("dt") <= 0).alias("duplicates"),
        F.count_if(F.col("dt") > F.col("median_dt") * drop_factor).alias("drops"),
    )
