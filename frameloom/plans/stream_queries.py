"""The online operators run over replayed frames; their oracles are the batch results on the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.operators import order as od
from frameloom.sources.trajectories import replay_steps
from frameloom.streaming import operators as st
from frameloom.streaming import timed as tm
from frameloom.streaming.buckets import buckets_for

from .registry import FRAMES, frames, query, r6, table, work_folder


def _stream(rows, folder: str, step: str, steps: int = 1):
    """Rows recorded in as many files as Spark likes, sorted by a column of steps, and replayed so many steps a trigger."""
    rows.repartitionByRange(step, "episode_id").sortWithinPartitions(step).write.parquet(f"{folder}/in")
    return replay_steps(rows.sparkSession, f"{folder}/in", rows.schema, steps, step)


def _replayed(spark, d, steps: int = 3):
    """Frames as a stream of a few batches, each a stretch of every episode."""
    folder = work_folder(spark)
    part = F.ntile(steps).over(Window.partitionBy("episode_id").orderBy("frame_index")).cast("bigint") - 1
    return _stream(frames(spark, d).drop("props").withColumn("part", part), folder, "part"), folder


def _by_time(spark, d, steps: int = 3):
    """Frames in order of time as a stream of a few batches, with us (microseconds since 1970, without a zone) and a
    watermark on ts."""
    folder = work_folder(spark)
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    f = frames(spark, d).drop("props").withColumn("us", us)
    ends = f.agg(F.min("us").alias("_a"), F.max("us").alias("_b"))
    slot = F.expr(f"(us - _a) * {steps} div (_b - _a + 1)").cast("bigint")
    rows = f.join(F.broadcast(ends)).withColumn("slot", slot).drop("_a", "_b").withColumn("ts", F.timestamp_micros("us"))
    return _stream(rows, folder, "slot").withWatermark("ts", "0 seconds"), folder


def _buckets(spark, d) -> int:
    return buckets_for(table(spark, d, "events").count())


def _moment(us: str):
    return F.expr(f"timestampadd(MICROSECOND, {us}, TIMESTAMP_NTZ '1970-01-01 00:00:00')")


@query(f"WITH {FRAMES}, s AS (SELECT 1 + max(frame_index) // 4 AS s FROM f) SELECT episode_id, frame_index, value, frame_index // s AS batch FROM f, s")
def stream_replay(spark, d):
    """A quarter of the longest episode a trigger; the query is stopped after its first batch and started again."""
    folder = work_folder(spark)
    f = frames(spark, d).select("episode_id", "frame_index", "value").withColumn("frame_index", F.col("frame_index").cast("bigint"))
    steps = 1 + f.agg(F.max("frame_index")).first()[0] // 4
    return st.run(_stream(f, folder, "frame_index", steps), "append", folder, stops=1)


@query("SELECT user_id AS episode_id, arg_max(value, ts) AS value FROM events GROUP BY 1")
def stream_latest(spark, d):
    stream, folder = _replayed(spark, d)
    out = st.run(st.newest_per_key(stream, "episode_id", "ts", "value"), "update", folder)
    return out.groupBy("episode_id").agg(F.max_by("value", "batch").alias("value"))


def _recurrence(first: str, next_: str, name: str, x: str = "value / 100") -> str:
    return f"""WITH RECURSIVE {FRAMES}, x AS (SELECT episode_id, frame_index, {x} AS x FROM f),
r AS (SELECT episode_id, frame_index, {first} FROM x WHERE frame_index = 0
 UNION ALL SELECT x.episode_id, x.frame_index, {next_} FROM r JOIN x ON x.episode_id = r.episode_id AND x.frame_index = r.frame_index + 1)
SELECT episode_id, frame_index, round(s, 6) AS {name} FROM r"""


def _fold(spark, d, x, start: tuple[float, ...], step, name: str, reset=None):
    stream, folder = _replayed(spark, d)
    rows = stream.select("episode_id", "frame_index", x.alias("x"), (F.lit(False) if reset is None else reset).alias("reset"))
    out = st.run(st.folded(rows, st.Fold(start, step), _buckets(spark, d)), "append", folder)
    return out.select("episode_id", "frame_index", r6("y").alias(name))


@query(_recurrence("0.2::DOUBLE * x AS s", "CASE WHEN x.x < r.s THEN 0.2::DOUBLE * r.s + 0.8::DOUBLE * x.x ELSE 0.8::DOUBLE * r.s + 0.2::DOUBLE * x.x END", "smooth"))
def stream_ema(spark, d):
    return _fold(spark, d, F.col("value") / 100, (0.0,), st.ema_step(), "smooth")


@query(_recurrence("(CASE WHEN x <= 0 THEN 0.0 ELSE 0.5 * x END)::DOUBLE AS s", "CASE WHEN x.x <= 0 THEN 0.0 WHEN x.x < r.s THEN 0.2::DOUBLE * r.s + 0.8::DOUBLE * x.x ELSE 0.5::DOUBLE * r.s + 0.5::DOUBLE * x.x END::DOUBLE", "force", "value / 97 - 0.3"))
def stream_force(spark, d):
    return _fold(spark, d, F.col("value") / 97 - 0.3, (0.0,), st.force_step(), "force")


_X = "least(greatest({x} * 0.4, 0.0), 1.0)::DOUBLE"
_OPENS = f"({_X.format(x='x.x')} <= 0.08 AND r.held + 1 >= 3)"
_C = _X.format(x="x.x")


@query(_recurrence(
    f"{_X.format(x='x')} AS s, {_X.format(x='x')} >= 0.18 AS shut, 0 AS held",
    f"""least(greatest(0.35::DOUBLE * (CASE WHEN r.shut AND NOT {_OPENS} THEN greatest(r.s, {_C}, 0.18) WHEN r.shut OR {_C} >= 0.18 OR {_C} <= 0.08 THEN {_C} ELSE r.s END) + 0.65::DOUBLE * r.s, 0.0), 1.0)::DOUBLE,
 CASE WHEN r.shut THEN NOT {_OPENS} ELSE {_C} >= 0.18 END, (CASE WHEN r.shut AND NOT {_OPENS} THEN r.held + 1 ELSE 0 END)::INT""", "gripper", "value / 97"))
def stream_gripper(spark, d):
    return _fold(spark, d, F.col("value") / 97 * 0.4, (0.0, 0.0, float("nan")), st.gripper_step(od.Gripper(hold=3)), "gripper")


@query(f"WITH {FRAMES}, g AS (SELECT *, lag(value) OVER (PARTITION BY episode_id ORDER BY frame_index) AS b FROM f) SELECT episode_id, frame_index FROM g WHERE b < 50 AND value >= 50")
def stream_edges(spark, d):
    return _fold(spark, d, F.col("value"), (50.0,), st.edge_step(50.0), "edge").where("edge = 1").select("episode_id", "frame_index")


@query(f"WITH {FRAMES} SELECT episode_id, frame_index, round(value - max(CASE WHEN frame_index % 20 = 0 THEN value END) OVER (PARTITION BY episode_id, frame_index // 20), 6) AS moved FROM f")
def stream_reference(spark, d):
    return _fold(spark, d, F.col("value"), (0.0, 0.0), st.reference_step(), "moved", F.col("frame_index") % 20 == 0)


@query(f"WITH {FRAMES} SELECT episode_id, frame_index, value FROM f WHERE frame_index > 0")
def stream_append(spark, d):
    stream, folder = _replayed(spark, d)
    return st.run(st.appended(stream).select("episode_id", "frame_index", "value"), "append", folder).drop("batch")


# Time that passes

_HOUR = 3_600_000_000
#: The frames with their time, and the last watermark.
_TIMED = f"{FRAMES}, t AS (SELECT episode_id, frame_index, event_type, value, epoch_us(ts) AS us FROM f), w AS (SELECT max(us) // 1000 * 1000 AS w FROM t)"


@query(f"""WITH {_TIMED}, a AS (SELECT episode_id, us, max(value) AS value FROM t GROUP BY 1, 2), b AS (SELECT episode_id, (min(us) + {6 * _HOUR - 1}) // {6 * _HOUR} * {6 * _HOUR} AS first FROM t GROUP BY 1),
k AS (SELECT episode_id, unnest(range(first, w, {6 * _HOUR})) AS us FROM b, w)
SELECT k.episode_id, make_timestamp(k.us) AS tick, a.value AS action FROM k ASOF JOIN a ON k.episode_id = a.episode_id AND k.us >= a.us""")
def stream_ticks(spark, d):
    """The action in force every six hours, whether or not one has come since."""
    stream, folder = _by_time(spark, d)
    out = st.run(tm.timed(stream.select("episode_id", "ts", F.col("value").alias("x")), tm.Ticks(6 * _HOUR), _buckets(spark, d)), "append", folder)
    return out.select("episode_id", _moment("us").alias("tick"), "action")


_CLICKS = f"""{_TIMED}, n AS (SELECT *, CASE WHEN us - lag(us) OVER o < {2 * _HOUR} THEN 0 ELSE 1 END AS new FROM t WINDOW o AS (PARTITION BY episode_id ORDER BY us, frame_index)),
s AS (SELECT *, sum(new) OVER (PARTITION BY episode_id ORDER BY us, frame_index) AS session FROM n),
r AS (SELECT *, (row_number() OVER (PARTITION BY episode_id, session ORDER BY us, frame_index) - 1) // 3 AS g, max(session) OVER (PARTITION BY episode_id) AS final FROM s),
c AS (SELECT episode_id, session, final, g, count(*) AS clicks, min(us) AS first_us, max(us) AS us FROM r GROUP BY ALL),
o AS (SELECT episode_id, first_us, us, CASE WHEN clicks = 3 THEN 'delete' ELSE 'save' END AS outcome FROM c, w WHERE clicks = 3 OR clicks = 2 AND (session < final OR us + {2 * _HOUR} < w))"""


def _outcomes(spark, d):
    stream, folder = _by_time(spark, d)
    return st.run(tm.timed(stream.select("episode_id", "ts"), tm.Clicks(2 * _HOUR), _buckets(spark, d)), "append", folder)


@query(f"WITH {_CLICKS} SELECT episode_id, make_timestamp(first_us) AS first_ts, make_timestamp(us) AS ts, outcome FROM o")
def stream_sessions(spark, d):
    """Clicks closer than two hours: a third deletes at once, two save when nothing follows."""
    return _outcomes(spark, d).select("episode_id", _moment("first_us").alias("first_ts"), _moment("us").alias("ts"), "outcome")


@query(f"WITH {_CLICKS} SELECT episode_id, frame_index, value FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.outcome = 'delete' AND o.episode_id = t.episode_id AND t.us BETWEEN o.first_us AND o.us)")
def stream_discards(spark, d):
    """Frames that are left when the deleted recordings are gone."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    f = frames(spark, d).select("episode_id", "frame_index", "value", us.alias("us"))
    return tm.without_recordings(f, _outcomes(spark, d)).select("episode_id", "frame_index", "value")


@query(f"""WITH {_TIMED}, a AS (SELECT episode_id, us, max(value) AS value FROM t WHERE event_type <> 'click' GROUP BY 1, 2), q AS (SELECT t.* FROM t, w WHERE event_type = 'click' AND us < w)
SELECT q.episode_id, q.frame_index, a.value AS latest FROM q ASOF LEFT JOIN a ON q.episode_id = a.episode_id AND q.us >= a.us""")
def stream_asof(spark, d):
    """For each click the newest value of any other event, both as streams."""
    stream, folder = _by_time(spark, d)
    asks = F.col("event_type") == "click"
    rows = stream.select("episode_id", "ts", F.when(asks, F.col("frame_index")).cast("bigint").alias("id"), F.when(~asks, F.col("value")).alias("x"))
    out = st.run(tm.timed(rows, tm.Latest(), _buckets(spark, d)), "append", folder)
    return out.select("episode_id", F.col("id").alias("frame_index"), F.col("x").alias("latest"))


@query(f"""WITH {_TIMED}, n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY episode_id ORDER BY us, frame_index) <= {12 * _HOUR} THEN 0 ELSE 1 END AS new FROM t),
s AS (SELECT *, sum(new) OVER (PARTITION BY episode_id ORDER BY us, frame_index) AS track FROM n)
SELECT episode_id, frame_index, round(value - first_value(value) OVER (PARTITION BY episode_id, track ORDER BY us, frame_index), 6) AS moved FROM s""")
def stream_tracking(spark, d):
    """Movement since tracking was found: the reference is forgotten after twelve hours without a frame."""
    stream, folder = _by_time(spark, d)
    rows = stream.select("episode_id", "ts", "frame_index", F.col("value").alias("x"))
    out = st.run(tm.timed(rows, tm.Tracked(12 * _HOUR, (0.0, 0.0), st.reference_step()), _buckets(spark, d)), "append", folder)
    return out.select("episode_id", "frame_index", r6("y").alias("moved"))


@query(f"""WITH {FRAMES}, c AS (SELECT episode_id, frame_index AS c, list(value) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS chunk FROM f),
p AS (SELECT episode_id, c, c + i - 1 AS t, chunk[i] + c AS a FROM c, range(1, 7) r(i) WHERE c % 2 = 0 AND i <= len(chunk)),
o AS (SELECT episode_id, t, list_reduce(list(a ORDER BY c), lambda z, y: z * 0.5 + y * 0.5) AS act FROM p GROUP BY 1, 2)
SELECT episode_id, t, round(act, 6) AS action FROM o""")
def stream_chunks(spark, d):
    """Chunks that arrive on their first step and overlap, one action a tick."""
    folder = work_folder(spark)
    f = frames(spark, d)
    w = Window.partitionBy("episode_id").orderBy("frame_index")
    chunk = F.transform(F.collect_list("value").over(w.rowsBetween(0, 5)), lambda v: v + F.col("frame_index"))
    rows = f.select("episode_id", F.col("frame_index").cast("bigint").alias("t"), chunk.alias("values"), (F.ntile(3).over(w).cast("bigint") - 1).alias("part"))
    rows = rows.select("episode_id", "t", F.when(F.col("t") % 2 == 0, F.col("t")).alias("chunk_t"), F.when(F.col("t") % 2 == 0, F.col("values")).alias("values"), "part")
    out = st.run(st.chunk_actions(_stream(rows, folder, "part"), st.ChunkQueue(), _buckets(spark, d)), "append", folder)
    return out.select("episode_id", "t", r6("action").alias("action"))
