"""Registration of queries with their DuckDB oracles, and the bindings of operators to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators.episodes import numbered
from frameloom.operators.tables import work_folder  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name; sql is its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """events as frames: a user is an episode."""
    events = table(spark, d, "events").withColumnRenamed("user_id", "episode_id")
    return numbered(events, "episode_id", ["ts", "event_id"])


#: The same for DuckDB.
FRAMES = "f AS (SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, event_id, ts, event_type, value, props FROM events)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as frames: a label is an episode."""
    rows = table(spark, d, "embeddings").withColumnRenamed("label", "episode_id")
    return numbered(rows, "episode_id", ["vec_id"]).withColumn("v", F.col("embedding").cast("array<double>"))


VECTORS = "e AS (SELECT label AS episode_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index, embedding::DOUBLE[] AS v FROM embeddings)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as frames: an order is an episode, its lines are seven-wide actions with a six-wide state."""
    rows = table(spark, d, "lineitem")
    out = numbered(rows.withColumnRenamed("l_orderkey", "episode_id"), "episode_id", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    q, p, disc, tax = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    state = F.array(q / 100, p / 99991, disc, tax, q * disc / 10, disc - tax)
    return out.select("episode_id", "frame_index", state.alias("state"), (disc * 10).alias("gripper"))


LINES = """n AS (SELECT l_orderkey AS episode_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS frame_index,
  [l_quantity / 100, l_extendedprice / 99991, l_discount, l_tax, l_quantity * l_discount / 10, l_discount - l_tax]::DOUBLE[] AS state, l_discount * 10 AS gripper FROM lineitem)"""


def r6(c: Column | str) -> Column:
    """round(c, 6), which works on decimals and is slow. A value that is no near tie is some millions of millionths: a whole
    number over a million is the same double as that decimal."""
    x = F.col(c) if isinstance(c, str) else c
    wide = x * F.lit(1e6)
    near = F.floor(wide + 0.5)
    return F.when((F.abs(wide) < 1e9) & (F.abs(wide - near) < 0.4999), near / F.lit(1e6)).otherwise(F.round(x, 6))
