"""Text layouts: rate logs, argument logs, headset lines, node listings, YAML and JSON configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.text import coerced


def parse_freq_lines(lines: DataFrame) -> DataFrame:
    """step, hz from ``step: hz`` lines; header and blank lines are left out. lines: value."""
    pattern = r"^\s*(\d+)\s*:\s*(.+)$"
    out = lines.select(F.regexp_extract("value", pattern, 1).try_cast("bigint").alias("step"), F.trim(F.regexp_extract("value", pattern, 2)).try_cast("double").alias("hz"))
    return out.where("step is not null and hz is not null")


def read_freq(spark: SparkSession, path: str) -> DataFrame:
    """episode (the file's folder), step, hz for each freq.txt below a path."""
    lines = spark.read.option("pathGlobFilter", "freq.txt").option("recursiveFileLookup", "true").text(path)
    dirs = lines.select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/freq\.txt$", 1).alias("episode_id"))
    pattern = r"^\s*(\d+)\s*:\s*(.+)$"
    rows = dirs.select("episode_id", F.regexp_extract("value", pattern, 1).try_cast("bigint").alias("step"), F.trim(F.regexp_extract("value", pattern, 2)).try_cast("double").alias("hz"))
    return rows.where("step is not null and hz is not null")


def read_args(spark: SparkSession, path: str) -> DataFrame:
    """key, value, kind from ``key: value`` lines."""
    parts = F.split("value", ": ", 2)
    rows = spark.read.text(path).where(F.col("value").contains(": "))
    return rows.select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value")).withColumn("kind", coerced(F.col("value")))


# What marks a line of the headset's stream, and the buttons of each hand.
HEADSET_TAG = "wE9ryARX"
RIGHT_BUTTONS = ("A", "B", "RThU", "RJ", "RG", "RTr")
LEFT_BUTTONS = ("X", "Y", "LThU", "LJ", "LG", "LTr")
_BUTTONS = "array<struct<k: string, v: array<double>>>"


def parse_headset(lines: DataFrame, tag: str = HEADSET_TAG) -> DataFrame:
    """Poses and buttons of a headset's text stream: after the tag, ``r:16 numbers|l:16 numbers&buttons``.

    side, matrix (16 numbers, row by row), buttons (map of name to numbers). A hand that is marked (R, L) has all its
    buttons, [1] where pressed and [0] where not; other names come with their numbers. Poses without 16 numbers are dropped.
    """
    body = F.when(F.col("value").contains(tag), F.element_at(F.split("value", f"{tag}: "), -1)).otherwise(F.lit(""))
    halves = F.split(body, "&")
    words = F.transform(F.split(F.get(halves, F.lit(1)), ","), lambda w: F.trim(w))
    none = F.array().cast("array<string>")
    hand = lambda mark, names: F.when(F.array_contains(words, mark), F.array(*[F.lit(n) for n in names])).otherwise(none)
    named = F.transform(F.concat(hand("R", RIGHT_BUTTONS), hand("L", LEFT_BUTTONS)), lambda n: F.struct(n.alias("k"), F.array(F.array_contains(words, n).cast("double")).alias("v")))
    valued = F.transform(F.filter(words, lambda w: w.contains(" ")), lambda w: F.struct(F.split(w, " ")[0].alias("k"), F.transform(F.slice(F.split(w, " "), 2, 8), lambda x: x.try_cast("double")).alias("v")))
    poses = lines.where(F.size(halves) == 2).select(F.map_from_entries(F.concat(named.cast(_BUTTONS), valued.cast(_BUTTONS))).alias("buttons"), F.explode(F.split(halves[0], r"\|")).alias("pose"))
    pair = F.split("pose", ":")
    matrix = F.transform(F.filter(F.split(F.get(pair, F.lit(1)), " "), lambda x: x != ""), lambda x: x.try_cast("double"))
    sides = poses.select(F.get(pair, F.lit(0)).alias("side"), matrix.alias("matrix"), "buttons")
    return sides.where((F.size("matrix") == 16) & ~F.exists("matrix", lambda x: x.isNull()))


def parse_nodes(lines: DataFrame) -> DataFrame:
    """lines with ``fields``, the ``Key=Value`` tokens of the node description in value as a map. A value may hold the sign
    itself; of equal keys the last counts; a token without the sign has a null value."""
    pairs = F.transform(F.filter(F.split("value", " +"), lambda t: t != ""), lambda t: F.split(t, "=", 2))
    entries = F.transform(pairs, lambda p: F.struct(p[0].alias("key"), F.get(p, F.lit(1)).alias("value")))
    newest = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return lines.withColumn("fields", F.map_from_entries(newest))


def load_yaml(path: str) -> dict:
    """A YAML file, on the driver; without a YAML library only ``key: value`` and JSON files are read."""
    text = open(path, encoding="utf-8").read()
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        try:
            return json.loads(text)
        except ValueError:
            pairs = (line.split(":", 1) for line in text.splitlines() if ":" in line and not line.lstrip().startswith("#"))
            return {k.strip(): v.strip() for k, v in pairs}


def crop_config(spark: SparkSession, path: str) -> DataFrame:
    """Crop configurations with an explicit schema."""
    schema = "points array<array<int>>, output_size array<int>, point_order string, source_h5 string, source_frame_index bigint"
    return spark.read.schema(schema).option("multiLine", "true").json(path)
