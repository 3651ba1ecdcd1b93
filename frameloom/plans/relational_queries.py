"""Positional and outer joins of frames with their streams and side files."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.operators.episodes import numbered, whole

from .registry import FRAMES, frames, query, table

SHORT = FRAMES + ", s AS (SELECT episode_id, frame_index, value * 2 AS pixel FROM (SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY frame_index) - 1 AS frame_index, value FROM f WHERE event_type = 'click'))"


def _stream(spark, d):
    """A shorter series: an episode's clicks, numbered."""
    clicks = frames(spark, d).where("event_type = 'click'").withColumnRenamed("frame_index", "_at")
    return numbered(clicks, "episode_id", ["_at"]).select("episode_id", "frame_index", (F.col("value") * 2).alias("pixel"))


@query(f"WITH {SHORT} SELECT episode_id, frame_index, value, pixel FROM f JOIN s USING (episode_id, frame_index)")
def shortest_series(spark, d):
    """Series joined by position and cut at the shortest."""
    return frames(spark, d).select("episode_id", "frame_index", "value").join(_stream(spark, d), ["episode_id", "frame_index"])


@query(f"WITH {SHORT} SELECT episode_id, count(*) FILTER (WHERE pixel IS NULL) AS missing FROM f LEFT JOIN s USING (episode_id, frame_index) GROUP BY 1")
def frames_without_stream(spark, d):
    """Series joined by position without a cut: frames that lack their stream are counted."""
    joined = frames(spark, d).join(_stream(spark, d), ["episode_id", "frame_index"], "left")
    return joined.groupBy("episode_id").agg(F.count_if(F.col("pixel").isNull()).alias("missing"))


@query("SELECT doc_id, coalesce(quality, -1) AS mask FROM documents LEFT JOIN labels USING (doc_id)")
def side_files(spark, d):
    """Frames with their mask file where there is one."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("mask"))


@query("SELECT o_orderkey, sum(l_quantity)::BIGINT AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_quantity > 10 GROUP BY 1")
def active_frames(spark, d):
    """Frames of active episodes."""
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    rows = table(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return rows.join(orders, "o_orderkey").groupBy("o_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("quantity"))


@query(f"WITH {FRAMES} SELECT episode_id, frame_index, frame_index / count(*) OVER (PARTITION BY episode_id)::DOUBLE AS share FROM f")
def length_lookup(spark, d):
    """The episode's length at each of its frames."""
    n = F.count(F.lit(1)).over(whole())
    return frames(spark, d).select("episode_id", "frame_index", (F.col("frame_index") / n).alias("share"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal >= 5000 THEN 'own' WHEN s_nationkey < 12 THEN 'shared' ELSE 'none' END AS config FROM supplier""")
def config_candidates(spark, d):
    """The first configuration that exists among ordered candidates."""
    rows = table(spark, d, "supplier")
    keys = rows.select("s_suppkey")
    own = rows.where("s_acctbal >= 5000").select("s_suppkey", F.lit("own").alias("own"))
    shared = rows.where("s_nationkey < 12").select("s_suppkey", F.lit("shared").alias("shared"))
    return keys.join(own, "s_suppkey", "left").join(shared, "s_suppkey", "left").select("s_suppkey", F.coalesce("own", "shared", F.lit("none")).alias("config"))


@query("""SELECT n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def revenue_by_nation(spark, d):
    """A star join: the dimension tables are small enough for the planner to broadcast."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    rows = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
