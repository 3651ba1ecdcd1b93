"""Recurrences, ensembles, sessions and as-of lookups. Oracles of recurrences are recursive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.operators import order as od
from frameloom.operators.episodes import by_episode

from .registry import FRAMES, frames, query, r6, table


@query(f"WITH {FRAMES} SELECT episode_id, frame_index, round(avg(value) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS mean50 FROM f")
def moving_average_50(spark, d):
    return frames(spark, d).select("episode_id", "frame_index", F.round(od.moving_average(F.col("value")), 9).alias("mean50"))


@query(f"WITH {FRAMES} SELECT episode_id, frame_index, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM f")
def hold_last(spark, d):
    x = F.when(F.col("event_type") == "click", F.col("value"))
    return frames(spark, d).select("episode_id", "frame_index", od.held(x).alias("held"))


@query("""SELECT a.event_id, (SELECT arg_max(b.value, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts) AS latest_value FROM events a WHERE a.event_type = 'view'""")
def asof_latest(spark, d):
    ev = table(spark, d, "events").withColumnRenamed("user_id", "episode_id")
    left = ev.where("event_type = 'view'").select("episode_id", "ts", "event_id")
    right = ev.where("event_type = 'purchase'").select("episode_id", "ts", "value")
    return od.as_of(left, right, "episode_id", "ts", "value").select("event_id", "latest_value")


def _recursion(rule: str, state0: str, states: str, result: str, out: str) -> str:
    return f"""WITH RECURSIVE {FRAMES}, x AS (SELECT episode_id, frame_index, value / 97 AS x FROM f),
r AS (SELECT episode_id, frame_index, {state0} FROM x WHERE frame_index = 0
 UNION ALL SELECT x.episode_id, x.frame_index, {rule} FROM r JOIN x ON x.episode_id = r.episode_id AND x.frame_index = r.frame_index + 1)
SELECT episode_id, frame_index, round({result}, 6) AS {out} FROM r"""


def _scaled(spark, d):
    return frames(spark, d).select("episode_id", "frame_index", (F.col("value") / 97).alias("x"))


@query(_recursion("CASE WHEN x.x < r.s THEN 0.2::DOUBLE * r.s + 0.8::DOUBLE * x.x ELSE 0.8::DOUBLE * r.s + 0.2::DOUBLE * x.x END AS s", "0.2::DOUBLE * x AS s", "s", "s", "smooth"))
def asymmetric_ema(spark, d):
    return od.asymmetric_ema(_scaled(spark, d), "x").withColumn("smooth", r6("smooth"))


@query(_recursion("0.35::DOUBLE * x.x + 0.65::DOUBLE * r.s AS s", "x AS s", "s", "s", "smooth"))
def joint_ema(spark, d):
    return od.joint_ema(_scaled(spark, d), "x").withColumn("smooth", r6("smooth"))


@query(_recursion("CASE WHEN x.x - 0.3 <= 0 THEN 0.0 WHEN x.x - 0.3 < r.s THEN 0.2::DOUBLE * r.s + 0.8::DOUBLE * (x.x - 0.3) ELSE 0.5::DOUBLE * r.s + 0.5::DOUBLE * (x.x - 0.3) END::DOUBLE AS s", "(CASE WHEN x - 0.3 <= 0 THEN 0.0 ELSE 0.5 * (x - 0.3) END)::DOUBLE AS s", "s", "s", "force"))
def force_smoothing(spark, d):
    rows = _scaled(spark, d).withColumn("x", F.col("x") - 0.3)
    return od.force_smoothing(rows, "x").withColumn("force", r6("force"))


_C = "least(greatest(x.x * 0.4, 0.0), 1.0)::DOUBLE"
_CLOSED = f"CASE WHEN r.closed THEN NOT ({_C} <= 0.08 AND r.held + 1 >= 3) ELSE {_C} >= 0.18 END"
_HELD = f"CASE WHEN r.closed AND NOT ({_C} <= 0.08 AND r.held + 1 >= 3) THEN r.held + 1 ELSE 0 END"
_TARGET = f"CASE WHEN r.closed THEN CASE WHEN {_C} <= 0.08 AND r.held + 1 >= 3 THEN {_C} ELSE greatest(r.s, {_C}, 0.18) END WHEN {_C} >= 0.18 THEN {_C} WHEN {_C} <= 0.08 THEN {_C} ELSE r.s END"
_FIRST = "least(greatest(x * 0.4, 0.0), 1.0)::DOUBLE"


@query(_recursion(f"least(greatest(0.35::DOUBLE * ({_TARGET}) + 0.65::DOUBLE * r.s, 0.0), 1.0)::DOUBLE AS s, {_CLOSED} AS closed, ({_HELD})::INT AS held", f"{_FIRST} AS s, {_FIRST} >= 0.18 AS closed, 0 AS held", "", "s", "gripper"))
def hysteresis_gripper(spark, d):
    rows = _scaled(spark, d).withColumn("x", F.col("x") * 0.4)
    return od.gripper_hysteresis(rows, "x", od.Gripper(hold=3)).withColumn("gripper", r6("gripper"))


@query(f"""WITH {FRAMES}, c AS (SELECT episode_id, frame_index AS chunk_at, list(value) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS chunk FROM f),
p AS (SELECT episode_id, chunk_at, chunk_at + i - 1 AS step, chunk[i] + chunk_at AS a FROM c, range(1, 7) r(i) WHERE chunk_at % 2 = 0 AND i <= len(chunk))
SELECT episode_id, step, round(avg(a), 6) AS avg, round(arg_min(a, chunk_at), 6) AS old, round(arg_max(a, chunk_at), 6) AS new, round(list_reduce(list(a ORDER BY chunk_at), lambda z, y: z * 0.5 + y * 0.5), 6) AS act FROM p GROUP BY 1, 2""")
def temporal_ensemble(spark, d):
    f = frames(spark, d)
    chunk = F.collect_list("value").over(by_episode().rowsBetween(0, 5))
    chunks = f.select("episode_id", F.col("frame_index").alias("chunk_at"), chunk.alias("values")).where("chunk_at % 2 = 0")
    out = od.ensemble(chunks.withColumn("values", F.transform("values", lambda v: v + F.col("chunk_at"))))
    return out.select("episode_id", "step", *[r6(c).alias(c) for c in ("avg", "old", "new", "act")])


@query(f"""WITH {FRAMES}, c AS (SELECT episode_id, frame_index AS chunk_at, list(value) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS chunk FROM f),
p AS (SELECT episode_id, chunk_at, chunk_at + i - 1 AS step, chunk[i] + chunk_at AS a FROM c, range(1, 7) r(i) WHERE chunk_at % 9 < 2 AND i <= len(chunk)),
o AS (SELECT episode_id, step, list_reduce(list(a ORDER BY chunk_at), lambda z, y: z * 0.5 + y * 0.5) AS act FROM p GROUP BY 1, 2),
k AS (SELECT episode_id, unnest(range(min(step), max(step) + 1)) AS step FROM o GROUP BY 1)
SELECT k.episode_id, k.step, round(o.act, 6) AS act FROM k ASOF JOIN o ON k.episode_id = o.episode_id AND k.step >= o.step""")
def temporal_ensemble_gaps(spark, d):
    """Chunks that leave steps uncovered: the last action is repeated there."""
    f = frames(spark, d)
    chunk = F.collect_list("value").over(by_episode().rowsBetween(0, 5))
    chunks = f.select("episode_id", F.col("frame_index").alias("chunk_at"), chunk.alias("values")).where("chunk_at % 9 < 2")
    out = od.repeated(od.ensemble(chunks.withColumn("values", F.transform("values", lambda v: v + F.col("chunk_at")))))
    return out.select("episode_id", "step", r6("act").alias("act"))


@query(f"""WITH {FRAMES}, g AS (SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY episode_id ORDER BY frame_index))) / 1e6 < 7200 THEN 0 ELSE 1 END AS new FROM f),
s AS (SELECT *, sum(new) OVER (PARTITION BY episode_id ORDER BY frame_index)::BIGINT AS session FROM g), o AS (SELECT episode_id, session, count(*) AS clicks FROM s GROUP BY 1, 2)
SELECT *, CASE WHEN clicks = 2 THEN 'save' WHEN clicks >= 3 THEN 'delete' ELSE 'none' END AS outcome FROM o""")
def click_sessions(spark, d):
    return od.sessions(frames(spark, d), 7200.0).select("episode_id", "session", "clicks", "outcome")


@query(f"WITH {FRAMES}, a AS (SELECT * FROM f WHERE event_type = 'click'), b AS (SELECT * FROM f WHERE event_type = 'view') SELECT a.episode_id, a.frame_index // 5 AS tick, round(max(a.value) + max(b.value), 6) AS total, 2 AS width FROM a JOIN b ON a.episode_id = b.episode_id AND a.frame_index // 5 = b.frame_index // 5 GROUP BY 1, 2")
def arm_concat(spark, d):
    f = frames(spark, d).withColumn("tick", F.floor(F.col("frame_index") / 5).cast("bigint"))
    arm = lambda kind: f.where(F.col("event_type") == kind).groupBy("episode_id", "tick").agg(F.array(F.max("value")).alias("v"))
    both = od.side_by_side(arm("click"), arm("view"), ["episode_id", "tick"], "v", "v")
    return both.select("episode_id", "tick", r6(F.col("both")[0] + F.col("both")[1]).alias("total"), F.size("both").alias("width"))


@query("SELECT event_id, event_id % 3 > 0 AS same FROM events")
def key_sets(spark, d):
    a = F.create_map(F.lit("x"), F.col("value"), F.lit("y"), F.col("value"))
    b = F.when(F.col("event_id") % 3 > 0, F.create_map(F.lit("y"), F.col("value"), F.lit("x"), F.col("value"))).otherwise(F.create_map(F.lit("x"), F.col("value")))
    return table(spark, d, "events").select("event_id", od.same_keys(a, b).alias("same"))
