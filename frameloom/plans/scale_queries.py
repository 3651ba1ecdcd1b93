"""Operators for long episodes and for files, tables and images that are dealt out to tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import images, streams
from frameloom.operators import segments
from frameloom.operators.episodes import numbered
from frameloom.sources import trajectories

from .registry import frames, query, r6, table, work_folder

#: One episode with nine tenths of all events; order within it by time and number.
_LONG = "l AS (SELECT CASE WHEN user_id % 10 = 3 THEN user_id ELSE 0 END AS episode_id, event_id, ts, event_type, value FROM events)"


def _long(spark, d):
    episode = F.when(F.col("user_id") % 10 == 3, F.col("user_id")).otherwise(0)
    return table(spark, d, "events").select(episode.cast("bigint").alias("episode_id"), "event_id", "ts", "event_type", "value")


@query(f"""WITH {_LONG}, a AS (SELECT episode_id, ts, max(value) AS value FROM l WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT q.event_id, a.value AS latest FROM (SELECT * FROM l WHERE event_type = 'view') q ASOF LEFT JOIN a ON q.episode_id = a.episode_id AND q.ts >= a.ts""")
def long_asof(spark, d):
    rows = _long(spark, d)
    out = segments.as_of(rows.where("event_type = 'view'").select("episode_id", "event_id", "ts"), rows.where("event_type = 'purchase'"), "episode_id", "ts", "value")
    return out.select("event_id", F.col("latest_value").alias("latest"))


@query(f"""WITH {_LONG} SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM l""")
def long_held(spark, d):
    x = F.when(F.col("event_id") % 5 == 0, F.col("value"))
    return segments.held(_long(spark, d), "episode_id", ["ts", "event_id"], x, "held").select("event_id", "held")


@query(f"WITH {_LONG} SELECT event_id, round(sum(value) OVER (PARTITION BY episode_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS position FROM l")
def long_replay(spark, d):
    return segments.replayed(_long(spark, d), "episode_id", ["ts", "event_id"], F.col("value"), "position").select("event_id", F.round("position", 4).alias("position"))


@query(f"WITH {_LONG} SELECT event_id, round(avg(value) OVER (PARTITION BY episode_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS average FROM l")
def long_average(spark, d):
    return segments.moving_average(_long(spark, d), "episode_id", ["ts", "event_id"], "value", 50, "average").select("event_id", F.round("average", 9).alias("average"))


@query("""WITH e AS (SELECT 'label_' || label || '/' || (vec_id // 5000) AS episode_id, vec_id, row_number() OVER (PARTITION BY label, vec_id // 5000 ORDER BY vec_id) - 1 AS frame_index, embedding FROM embeddings)
SELECT episode_id, frame_index, count(*) OVER (PARTITION BY episode_id) AS frame_count, round(embedding[2]::DOUBLE, 6) AS x, len(embedding) AS width FROM e WHERE true QUALIFY frame_index >= 3 AND frame_index < 40""")
def trajectory_scan(spark, d):
    """Vectors written as trajectory files in two phases and read back: one of two fields, a range of frames."""
    rows = table(spark, d, "embeddings").withColumn("episode_id", F.concat(F.lit("label_"), "label", F.lit("/"), F.expr("vec_id div 5000")))
    path = work_folder(spark, "trajectories")
    state = numbered(rows, "episode_id", ["vec_id"]).select("episode_id", "frame_index", F.col("embedding").cast("array<double>").alias("state"), F.col("vec_id").cast("double").alias("number"))
    trajectories.write_trajectories(state, path, container="npz")
    schema = "episode_id string, frame_index bigint, frame_count bigint, pose array<double>"
    found = spark.read.format("trajectories").schema(schema).option("aliases", '{"pose": ["state"]}').load(path)
    return found.where("frame_index >= 3 and frame_index < 40").select("episode_id", "frame_index", "frame_count", r6(F.col("pose")[1]).alias("x"), F.size("pose").cast("bigint").alias("width"))


@query("""SELECT label AS episode_id, vec_id AS frame_index, i::INT AS camera_index, CASE WHEN vec_id % 3 = 0 THEN 'wrist_rgb' ELSE 'base_depth_' || i END AS stream, embedding[i * 8 + 1]::DOUBLE AS x
FROM embeddings, range(0, 3) r(i) WHERE vec_id % 3 < 2 AND (i = 0 OR vec_id % 3 = 1)""")
def camera_streams_sql(spark, d):
    """The split of camera fields as a table function in SQL; a third of the fields are no streams."""
    streams.register(spark)
    cams = F.when(F.col("vec_id") % 3 == 0, F.array(F.slice("embedding", 1, 8))).otherwise(F.array(*[F.slice("embedding", i * 8 + 1, 8) for i in range(3)]))
    key = F.element_at(F.array(F.lit("wrist_rgb"), F.lit("base_depth"), F.lit("joint_positions")), (F.col("vec_id") % 3 + 1).cast("int"))
    rows = table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("episode_id"), F.col("vec_id").cast("bigint").alias("frame_index"), key.alias("key"), cams.cast("array<array<double>>").alias("cameras"))
    sql = "SELECT episode_id, frame_index, camera_index, stream, payload[0] AS x FROM camera_streams(TABLE({rows}) PARTITION BY episode_id)"
    return spark.sql(sql, rows=rows)


_GRID = """p AS (SELECT vec_id, (i // 5)::INT AS r, (i % 5)::INT AS c, 20 * (i % 5) + embedding[i + 1]::DOUBLE AS x, 20 * (i // 5) + embedding[i + 21]::DOUBLE AS y FROM embeddings, range(0, 20) g(i)),
s AS (SELECT *, count(*) OVER (PARTITION BY vec_id, r) AS n FROM p WHERE vec_id % 3 = 0 OR vec_id % 3 = 1 AND (r, c) NOT IN ((1, 2), (3, 1)) OR vec_id % 3 = 2 AND (r + c) % 2 = 0)"""


@query(f"""WITH {_GRID}, f AS (SELECT vec_id, r, regr_slope(x, c) AS a, regr_intercept(x, c) AS b, median(y) AS my FROM s WHERE vec_id % 3 = 1 GROUP BY 1, 2)
SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY y, x) - 1)::INT AS nth, round(x, 4) AS x, round(y, 4) AS y, false AS regular FROM s WHERE vec_id % 3 = 2
UNION ALL SELECT vec_id, r * 5 + c, round(x, 4), round(y, 4), true FROM s WHERE vec_id % 3 < 2
UNION ALL SELECT vec_id, r * 5 + c, round(a * c + b, 4), round(my, 4), true FROM f, (VALUES (1, 2), (3, 1)) h(hr, c) WHERE r = hr""")
def marker_grids(spark, d):
    """Markers of four rows of five: whole images, images with two holes, and images with half of the markers."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 40)).alias("i", "v"))
    both = e.groupBy("vec_id", (F.col("i") % 20).alias("i")).agg(F.max(F.when(F.col("i") < 20, F.col("v"))).cast("double").alias("dx"), F.max(F.when(F.col("i") >= 20, F.col("v"))).cast("double").alias("dy"))
    r, c = F.expr("i div 5"), F.col("i") % 5
    p = both.select("vec_id", r.alias("r"), c.alias("c"), (20 * c + F.col("dx")).alias("x"), (20 * r + F.col("dy")).alias("y"))
    seen = p.where("vec_id % 3 = 0 or vec_id % 3 = 1 and not (r = 1 and c = 2 or r = 3 and c = 1) or vec_id % 3 = 2 and (r + c) % 2 = 0")
    return images.marker_grids(seen, 4, 5, "vec_id").select("vec_id", "nth", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "regular")
