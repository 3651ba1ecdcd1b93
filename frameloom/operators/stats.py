"""Statistics for normalisation and reports. Standard deviations are of the population; percentiles interpolate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.vectors import denormalised, normalised

from .episodes import whole
from .quantiles import exact_quantiles


def long_form(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """One row for each element: keys, dim, x."""
    return rows.select(*keys, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def min_max(elements: DataFrame) -> DataFrame:
    return elements.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def refuse_large(stats: DataFrame, limit: float = 1e5) -> DataFrame:
    """The statistics; raises where a bound lies beyond the limit."""
    big = F.greatest(F.abs("lo"), F.abs("hi")) > limit
    return stats.withColumn("lo", F.when(big, F.raise_error(F.lit("values out of range")).cast("double")).otherwise(F.col("lo")))


def mean_std(elements: DataFrame) -> DataFrame:
    return elements.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def nan_aware(elements: DataFrame) -> DataFrame:
    """The same over the numbers that are there, with marks for NaN and infinity."""
    x = F.when(~F.isnan("x"), F.col("x"))
    return elements.groupBy("dim").agg(
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.coalesce(F.bool_or(F.isnan("x")), F.lit(False)).alias("has_nan"), F.coalesce(F.bool_or(F.abs("x") == F.lit(float("inf"))), F.lit(False)).alias("has_inf"),
    )


# Ranges of hand slots, in order of the fingers, for states; actions of hands lie in [0, 1].
HAND_LOW = (5.0, 5.0, 5.0, 5.0, 5.0, 5.0)
HAND_HIGH = (110.0, 110.0, 110.0, 110.0, 90.0, 120.0)


def override_ranges(stats: DataFrame, slots: dict[int, tuple[float, float]]) -> DataFrame:
    """Statistics with given ranges for some dimensions. slots: one entry a dimension of the vector."""
    lows = F.create_map(*[F.lit(v) for d, (lo, _) in slots.items() for v in (d, lo)])
    highs = F.create_map(*[F.lit(v) for d, (_, hi) in slots.items() for v in (d, hi)])
    return stats.withColumn("lo", F.coalesce(F.try_element_at(lows, F.col("dim")), F.col("lo"))).withColumn("hi", F.coalesce(F.try_element_at(highs, F.col("dim")), F.col("hi")))


def hand_slots(first: int = 6, second: int = 18) -> dict[int, tuple[float, float]]:
    return {base + i: (lo, hi) for base in (first, second) for i, (lo, hi) in enumerate(zip(HAND_LOW, HAND_HIGH))}


def normalise(elements: DataFrame, stats: DataFrame) -> DataFrame:
    """elements with y in [-1, 1]. stats has one row a dimension, so it is broadcast."""
    return elements.join(F.broadcast(stats.select("dim", "lo", "hi")), "dim").withColumn("y", normalised(F.col("x"), F.col("lo"), F.col("hi")))


def _bounds(stats: DataFrame) -> DataFrame:
    """One row: the bounds of all dimensions in order, as many as a vector is wide."""
    ordered = F.sort_array(F.collect_list(F.struct("dim", "lo", "hi")))
    return stats.agg(F.transform(ordered, lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"))).alias("_bounds"))


def normalise_vectors(rows: DataFrame, vector: str, stats: DataFrame, out: str = "y") -> DataFrame:
    """rows with the whole vector in [-1, 1]: no row an element, no shuffle; the bounds are one broadcast row."""
    with_bounds = rows.crossJoin(F.broadcast(_bounds(stats)))
    return with_bounds.withColumn(out, F.zip_with(vector, "_bounds", lambda x, b: normalised(x.cast("double"), b["lo"], b["hi"]))).drop("_bounds")


def denormalise_vectors(rows: DataFrame, vector: str, stats: DataFrame, out: str = "back") -> DataFrame:
    """The inverse of normalise_vectors()."""
    with_bounds = rows.crossJoin(F.broadcast(_bounds(stats)))
    return with_bounds.withColumn(out, F.zip_with(vector, "_bounds", lambda y, b: denormalised(y, b["lo"], b["hi"]))).drop("_bounds")


def denormalise(elements: DataFrame) -> DataFrame:
    return elements.withColumn("back", denormalised(F.col("y"), F.col("lo"), F.col("hi")))


def safe_corr(a: Column, b: Column, least_std: float = 1e-8) -> Column:
    """Correlation; null where a side hardly varies."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa >= least_std) & (sb >= least_std), F.try_divide(F.covar_pop(a, b), sa * sb))


def outlier_counts(rows: DataFrame, xyz: Column, rotation: Column, gripper: Column) -> DataFrame:
    return rows.agg(F.count_if(xyz > 0.10).alias("large_xyz"), F.count_if(rotation > 0.75).alias("large_rot"), F.count_if((gripper < -0.05) | (gripper > 1.05)).alias("gripper_out"))


def display_range(rows: DataFrame, x: str) -> DataFrame:
    """Percentiles 1 and 99 of the positive values, exact; null if there are none."""
    q = exact_quantiles(rows.where(F.col(x) > 0), x, [0.01, 0.99]).select(F.col("quantiles")[0].alias("p1"), F.col("quantiles")[1].alias("p99"))
    return q.agg(F.max("p1").alias("p1"), F.max("p99").alias("p99"))


def plot_bounds(rows: DataFrame, x: str, *keys: str) -> DataFrame:
    """Range of the numbers with a margin of a tenth; half a unit to each side if flat, 0 to 1 if there are none."""
    good = F.when(~F.isnan(x), F.col(x))
    per = rows.groupBy(*keys).agg(F.min(good).alias("a"), F.max(good).alias("b"))
    margin = F.when(F.col("b") - F.col("a") < 1e-6, 0.5).otherwise((F.col("b") - F.col("a")) * 0.1)
    return per.select(*keys, F.coalesce(F.col("a") - margin, F.lit(0.0)).alias("lo"), F.coalesce(F.col("b") + margin, F.lit(1.0)).alias("hi"))


def inferred_fps(dt: DataFrame, default: int = 10) -> DataFrame:
    """Rounded half to even: 1 / mean positive step, and 1 / median positive step kept in [1, 120] (15 without any)."""
    positive = F.when(F.col("dt") > 0, F.col("dt"))
    return dt.groupBy("episode_id").agg(
        F.coalesce(F.greatest(F.lit(1.0), F.rint(F.lit(1.0) / F.avg(positive))), F.lit(float(default))).alias("fps"),
        F.coalesce(F.least(F.greatest(F.lit(1.0) / F.median(positive), F.lit(1.0)), F.lit(120.0)), F.lit(15.0)).alias("video_fps"),
    )


def rate_summary(rates: DataFrame, skip_first: bool = True) -> DataFrame:
    """AG19: average, highest, lowest and deviation of rates; step 0 is left out if asked."""
    kept = rates.where("step > 0") if skip_first else rates
    return kept.groupBy("episode_id").agg(F.avg("hz").alias("avg_hz"), F.max("hz").alias("max_hz"), F.min("hz").alias("min_hz"), F.stddev_pop("hz").alias("std_hz"))


def motion_summary(rows: DataFrame, key: str, motion: str) -> DataFrame:
    """AG20: smallest, largest and mean motion of each stream, 0 when there is none."""
    z = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return rows.groupBy(key).agg(z(F.min(motion), "lo"), z(F.max(motion), "hi"), z(F.avg(motion), "mean"))


def latest(rows: DataFrame, run: str, name: str, pattern: str = r"(\d+)(?!.*\d)") -> DataFrame:
    """AG22: the name with the largest number in it, for each run."""
    return rows.withColumn("_n", F.regexp_extract(name, pattern, 1).try_cast("bigint")).groupBy(run).agg(F.max_by(name, F.struct("_n", name)).alias(name))


def per_episode(rows: DataFrame, x: str) -> DataFrame:
    return rows.withColumn("episode_mean", F.avg(x).over(whole()))
