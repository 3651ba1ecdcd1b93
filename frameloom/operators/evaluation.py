"""Scores of predictions against recorded actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .episodes import small, whole
from .quantiles import exact_quantiles


def progress(frames: DataFrame) -> DataFrame:
    """frames with progress i / (n - 1) and its phase: early below 0.3, middle below 0.6, late."""
    n = F.max("frame_index").over(whole()) + 1
    p = F.col("frame_index") / F.greatest(n - 1, F.lit(1))
    return frames.withColumn("progress", p).withColumn("phase", F.when(F.col("progress") < 0.3, "early").when(F.col("progress") < 0.6, "middle").otherwise("late"))


def squared_error(pred: Column, target: Column) -> Column:
    return (pred - target) * (pred - target)


def mse_by_phase(samples: DataFrame, sse: str = "sse", n: str = "n") -> DataFrame:
    """Overall (phase null) and by phase: samples, mse and rmse weighted by elements, and mean, median and 90th percentile of
    the samples' own mse. samples: phase, sse, n (elements). Percentiles are exact and gather nothing."""
    own = F.col(sse) / F.col(n)
    mse = F.sum(sse) / F.sum(n)
    sums = samples.groupingSets([[], ["phase"]], "phase").agg(F.count(F.lit(1)).alias("samples"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(own).alias("mean_sample_mse"))
    each = samples.select(F.explode(F.array(F.lit(None).cast("string"), F.col("phase"))).alias("phase"), own.alias("own"))
    q = exact_quantiles(each, "own", [0.5, 0.9], ["phase"])
    shares = q.select(F.col("phase").alias("_phase"), F.col("quantiles")[0].alias("median_sample_mse"), F.col("quantiles")[1].alias("p90_sample_mse"))
    return sums.join(shares, F.col("phase").eqNullSafe(F.col("_phase")), "left").drop("_phase")


def mse_by_dim(elements: DataFrame, pred: str, target: str) -> DataFrame:
    return elements.groupBy("dim").agg(F.avg(squared_error(F.col(pred), F.col(target))).alias("mse"))


def mean_of_means(rows: DataFrame, error: Column) -> DataFrame:
    """The mean of the episodes' means; NaN when there is nothing."""
    return rows.groupBy("episode_id").agg(F.avg(error).alias("e")).agg(F.coalesce(F.avg("e"), F.lit(float("nan"))).alias("mean_of_means"))


def mae(rows: DataFrame, pred: str, target: str, change: str | None = None) -> DataFrame:
    """Mean absolute error of each episode and, if asked, the mean absolute change of the target."""
    more = [F.avg(F.abs(change)).alias("mean_abs_change")] if change else []
    return rows.groupBy("episode_id").agg(F.avg(F.abs(F.col(pred) - F.col(target))).alias("mae"), *more)


def against_all(checkpoints: DataFrame, samples: DataFrame) -> DataFrame:
    """Every checkpoint with every sample; the list of checkpoints is broadcast if it is short."""
    return samples.join(small(checkpoints), how="cross")
