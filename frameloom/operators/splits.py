"""Splits, samples and set operations on lists of episodes."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .episodes import small


def hash_split(episodes: DataFrame, key: str, seed: str, test: int = 1) -> DataFrame:
    """Train or test for each episode: the last ``test`` in the order of a seeded hash are the test set. The same rows
    give the same split in any order and on any number of executors."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    marked = episodes.select(key, order.alias("_h"))
    tests = marked.orderBy(F.desc("_h"), F.desc(key)).limit(test).select(key, F.lit("test").alias("_t"))
    return marked.join(small(tests), key, "left").select(key, F.coalesce("_t", F.lit("train")).alias("split"))


def seeded_split(names: list[str], seed: int) -> tuple[list[str], list[str]]:
    """Train and test names by Python's seeded shuffle of the sorted list: the last is the test set."""
    order = sorted(names)
    random.Random(seed).shuffle(order)
    return order[:-1], order[-1:]


def seeded_subset(names: list[str], n: int, seed: int) -> list[str]:
    order = sorted(names)
    random.Random(seed).shuffle(order)
    return order[:n]


def seeded_sample(names: list[str], n: int, seed: int | None = None, at_least: int = 101) -> list[str]:
    """n names without repeats; refuses short lists."""
    if len(names) < at_least:
        raise ValueError(f"{at_least} names are needed, there are {len(names)}")
    return random.Random(seed).sample(sorted(names), n)


def assignment(episodes: DataFrame, key: str, chosen: list[str], label: str, other: str) -> DataFrame:
    """A split table in place of links or moved files."""
    return episodes.select(key, F.when(F.col(key).isin(chosen), label).otherwise(other).alias("split"))


def todo(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """What has no output yet."""
    return wanted.join(existing.select(key).distinct(), key, "left_anti")


def done_counts(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    marked = wanted.select(key).join(existing.select(key).distinct().withColumn("_e", F.lit(1)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_e").isNull()).alias("to_do"), F.count_if(F.col("_e").isNotNull()).alias("skipped"))


def difference(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.distinct().subtract(present.distinct())


def all_but_last(names: DataFrame, root: str, name: str) -> DataFrame:
    """Train and test by position: the last name of each root is the test set."""
    last = F.row_number().over(Window.partitionBy(root).orderBy(F.desc(name))) == 1
    return names.withColumn("split", F.when(last, "test").otherwise("train"))


def prompt_by_cutoff(episode: Column, cutoff: str, before: str, after: str) -> Column:
    return F.when(episode <= cutoff, before).otherwise(after)


def grid_plan(clips: DataFrame, columns: int, length: int) -> DataFrame:
    """Which clip and frame each tile of a grid shows at each time: a clip that has ended holds its last frame.
    clips: position, clip, n_frames."""
    t = clips.select("position", "clip", "n_frames", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("t"))
    frame = F.when(F.col("n_frames") > 0, F.least(F.col("t"), F.col("n_frames") - 1))
    return t.select("t", F.floor(F.col("position") / columns).cast("int").alias("row"), (F.col("position") % columns).cast("int").alias("column"), "clip", frame.cast("bigint").alias("frame"))
