"""Trim, integrity and action queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import vectors as vec
from frameloom.operators import actions, integrity, trim
from frameloom.operators.episodes import by_episode, episode_lengths

from .registry import FRAMES, LINES, VECTORS, frames, lines, query, r6, table, vectors

THRESHOLD, RUN, PAD = 20.0, 3, 5

TRIMS = (
    FRAMES
    + """, m AS (SELECT episode_id, frame_index, count(*) OVER (PARTITION BY episode_id) AS n,
  coalesce(abs(lead(value) OVER (PARTITION BY episode_id ORDER BY frame_index) - value) > 20.0, false)::INT AS m FROM f),
r AS (SELECT *, min(m) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS r FROM m),
g AS (SELECT episode_id, max(n) AS n, min(CASE WHEN r = 1 AND frame_index + 3 <= n - 1 THEN frame_index END) AS lo,
  max(CASE WHEN r = 1 AND frame_index + 3 <= n - 1 THEN frame_index END) AS hi FROM r GROUP BY 1),
t AS (SELECT episode_id, n, CASE WHEN lo IS NULL THEN 0 ELSE greatest(0, lo - 5) END AS "start",
  CASE WHEN lo IS NULL THEN n ELSE least(n, hi + 3 + 1 + 5) END AS "end" FROM g)"""
)


def _ranges(spark, d):
    f = frames(spark, d)
    step = F.abs(F.lead("value").over(by_episode()) - F.col("value"))
    return trim.trim_ranges(f, step, THRESHOLD, RUN, PAD)


@query(f'WITH {TRIMS} SELECT episode_id, n, "start", "end", "start" AS removed_head, n - "end" AS removed_tail FROM t')
def motion_trim_ranges(spark, d):
    return _ranges(spark, d)


@query(f'WITH {TRIMS} SELECT episode_id, event_id, frame_index - "start" AS frame_index, value FROM f JOIN t USING (episode_id) WHERE frame_index >= "start" AND frame_index < "end"')
def trimmed_frames(spark, d):
    return trim.trimmed(frames(spark, d), _ranges(spark, d)).select("episode_id", "event_id", "frame_index", "value")


@query(f'WITH {TRIMS} SELECT count(*) AS episodes, count(*) FILTER (WHERE "start" + n - "end" > 0) AS trimmed, sum("start")::BIGINT AS removed_head, sum(n - "end")::BIGINT AS removed_tail FROM t')
def trim_totals(spark, d):
    return trim.trim_totals(_ranges(spark, d))


@query(f"""WITH {TRIMS}, q AS (SELECT episode_id, frame_index AS step, value AS hz FROM f UNION ALL SELECT episode_id, max(frame_index) + 1, 1.0 FROM f GROUP BY 1),
k AS (SELECT episode_id, step, hz FROM q JOIN t USING (episode_id) WHERE step - 1 >= "start" AND step - 1 < "end")
SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY step) - 1 AS step, hz, round(avg(hz) OVER w, 6) AS avg_hz, max(hz) OVER w AS max_hz, min(hz) OVER w AS min_hz, round(stddev_pop(hz) OVER w, 6) AS std_hz
FROM k WINDOW w AS (PARTITION BY episode_id)""")
def trimmed_rates(spark, d):
    f = frames(spark, d)
    log = f.select("episode_id", F.col("frame_index").alias("step"), F.col("value").alias("hz"))
    more = f.groupBy("episode_id").agg((F.max("frame_index") + 1).alias("step")).withColumn("hz", F.lit(1.0))
    out = trim.trimmed_rates(log.unionByName(more), _ranges(spark, d))
    return out.withColumn("avg_hz", r6("avg_hz")).withColumn("std_hz", r6("std_hz"))


DT = FRAMES + ", s AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY episode_id ORDER BY frame_index))) / 1e6 AS dt FROM f)"


@query(f"""WITH {DT}, p AS (SELECT episode_id, median(dt) FILTER (WHERE dt > 0) AS med FROM s GROUP BY 1)
SELECT episode_id, round(1.0 / avg(dt) FILTER (WHERE dt > 0), 6) AS mean_hz, min(dt) AS min_dt, max(dt) AS max_dt, count(*) FILTER (WHERE dt <= 0) AS duplicates, count(*) FILTER (WHERE dt > 2.5 * med) AS drops
FROM s JOIN p USING (episode_id) WHERE dt IS NOT NULL GROUP BY 1""")
def timestep_report(spark, d):
    return integrity.timestep_report(frames(spark, d)).withColumn("mean_hz", r6("mean_hz"))


@query(f"WITH {DT} SELECT episode_id, max(dt) AS max_dt, round(avg(dt), 6) AS avg_dt FROM s GROUP BY 1 HAVING avg(dt) > 0 AND max(dt) > greatest(1.0, 5.0 * avg(dt))")
def gap_warnings(spark, d):
    return integrity.gap_warnings(frames(spark, d)).withColumn("avg_dt", r6("avg_dt"))


@query("""WITH c AS (SELECT conv_id AS episode_id, turn, (turn * 7) % 5 AS t FROM conversations),
b AS (SELECT *, t <= lag(t) OVER (PARTITION BY episode_id ORDER BY turn) AS bad FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY turn) AS nth FROM b WHERE bad)
SELECT episode_id, count(*) AS n_violations, string_agg(CASE WHEN nth <= 2 THEN turn::VARCHAR END, ',' ORDER BY turn) AS first, greatest(count(*) - 2, 0) AS n_more FROM k GROUP BY 1""")
def monotonic_violations(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("episode_id"), "turn", (F.col("turn") * 7 % 5).alias("t"))
    return integrity.not_increasing(rows, "turn", "t", show=2)


@query("""WITH g AS (SELECT user_id AS episode_id, s.stream FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type || '_left' AS stream FROM events UNION SELECT DISTINCT event_type FROM events) s)
SELECT episode_id, stream FROM g WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = g.episode_id AND e.event_type = g.stream)""")
def missing_streams(spark, d):
    events = table(spark, d, "events")
    kinds = events.select(F.col("event_type").alias("stream")).distinct()
    expected = kinds.unionByName(kinds.select(F.concat("stream", F.lit("_left")).alias("stream")))
    return integrity.missing_streams(events.select(F.col("user_id").alias("episode_id"), F.col("event_type").alias("stream")), expected)


@query("""SELECT doc_id AS episode_id, 'issue' AS severity, 'length_mismatch' AS code,
concat_ws(',', CASE WHEN length(text) <> n_chars - doc_id % 2 THEN 'text=' || length(text) END, CASE WHEN length(lang) <> n_chars - doc_id % 2 THEN 'zlang=' || length(lang) END) AS detail
FROM documents WHERE length(text) <> n_chars - doc_id % 2 OR length(lang) <> n_chars - doc_id % 2""")
def length_mismatch(spark, d):
    docs = table(spark, d, "documents")
    lengths = F.create_map(F.lit("text"), F.char_length("text").cast("bigint"), F.lit("zlang"), F.char_length("lang").cast("bigint"))
    return integrity.length_mismatches(docs.select(F.col("doc_id").alias("episode_id"), (F.col("n_chars") - F.col("doc_id") % 2).alias("frame_count_attr"), lengths.alias("lengths")))


@query(f"""WITH {VECTORS} SELECT episode_id, sum(len(list_filter(v, lambda x: isnan(CASE WHEN x > 0.2 THEN 'nan'::DOUBLE ELSE x END) OR isinf(x))))::BIGINT AS n_bad FROM e GROUP BY 1""")
def nonfinite_scan(spark, d):
    rows = vectors(spark, d)
    return integrity.not_finite_counts(rows.withColumn("v", F.transform("v", lambda x: F.when(x > 0.2, F.lit(float("nan"))).otherwise(x))), "v")


ISSUES = (
    DT
    + """, i AS (
SELECT episode_id, 'warning' AS severity, 'large_gap' AS code, max(dt)::VARCHAR AS detail FROM s GROUP BY 1 HAVING avg(dt) > 0 AND max(dt) > greatest(1.0, 5.0 * avg(dt))
UNION ALL SELECT episode_id, 'issue', 'short', count(*)::VARCHAR FROM f GROUP BY 1 HAVING count(*) < 60
UNION ALL SELECT episode_id, 'issue', 'frame_count', (count(*) - 70)::VARCHAR FROM f GROUP BY 1 HAVING count(*) - 70 <= 0
UNION ALL SELECT episode_id, 'warning', 'rate_log', (count(*) + episode_id % 3)::VARCHAR FROM f GROUP BY 1 HAVING episode_id % 3 = 2)"""
)


def _issues(spark, d):
    f = frames(spark, d)
    eps = episode_lengths(f).select("episode_id", "n_frames")
    gaps = integrity.gap_warnings(f)
    return integrity.gathered(
        integrity.issue(gaps, F.lit(True), "warning", "large_gap", F.col("max_dt")),
        integrity.issue(eps, F.col("n_frames") < 60, "issue", "short", F.col("n_frames")),
        integrity.frame_count_rule(eps.withColumn("frame_count_attr", F.col("n_frames") - 70)),
        integrity.rate_log_rule(eps.select("episode_id", F.col("n_frames").alias("frame_count_attr"), (F.col("n_frames") + F.col("episode_id") % 3).alias("n_rates"))),
    )


@query(f"WITH {ISSUES} SELECT episode_id, severity, code FROM i")
def issue_rows(spark, d):
    return _issues(spark, d).select("episode_id", "severity", "code")


@query(f"""WITH {ISSUES}, k AS (SELECT episode_id, bool_or(severity <> 'warning') AS bad, bool_or(severity = 'warning') AS warned FROM i GROUP BY 1),
e AS (SELECT episode_id, count(*) AS n FROM f GROUP BY 1)
SELECT count(*) AS checked, count(*) FILTER (WHERE NOT coalesce(bad, false)) AS ok, count(*) FILTER (WHERE coalesce(bad, false)) AS bad, count(*) FILTER (WHERE coalesce(warned, false)) AS warned, sum(n)::BIGINT AS frames FROM e LEFT JOIN k USING (episode_id)""")
def integrity_summary(spark, d):
    return integrity.integrity_summary(episode_lengths(frames(spark, d)), _issues(spark, d))


@query("SELECT user_id AS episode_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS values FROM events GROUP BY 1")
def distinct_values(spark, d):
    return integrity.distinct_counts(table(spark, d, "events").withColumnRenamed("user_id", "episode_id"), "event_type")


@query("""SELECT episode_id, severity, code FROM (
SELECT doc_id AS episode_id, 'issue' AS severity, 'timestamps_missing' AS code FROM documents WHERE lang = 'de'
UNION ALL SELECT doc_id, 'issue', 'timestamps_length' FROM documents WHERE lang IS DISTINCT FROM 'de' AND doc_id % 2 = 1
UNION ALL SELECT doc_id, 'issue', 'timestamps_unreadable' FROM documents WHERE lang IS DISTINCT FROM 'de' AND doc_id % 3 = 0)""")
def timestamp_issues(spark, d):
    """Documents as episodes of three frames; German ones have no times, odd ones claim a frame more."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("episode_id"), "lang")
    episodes = docs.select("episode_id", (3 + F.col("episode_id") % 2).alias("frame_count_attr"))
    times = docs.where("not (lang <=> 'de')").select("episode_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("frame_index"))
    raw = F.when((F.col("episode_id") % 3 == 0) & (F.col("frame_index") == 1), "soon").otherwise(F.concat(F.lit("2024-01-01T00:00:0"), F.col("frame_index")))
    return integrity.timestamp_rules(times.withColumn("raw", raw), episodes).select("episode_id", "severity", "code")


@query("""SELECT page_id AS episode_id, severity, code FROM (
SELECT page_id, 'issue' AS severity, 'stream_empty' AS code FROM pages WHERE page_id % 7 = 0
UNION ALL SELECT page_id, 'warning', 'stream_attributes' FROM pages WHERE page_id % 4 = 0
UNION ALL SELECT page_id, 'issue', 'decoded_count' FROM pages WHERE page_id % 3 = 2
UNION ALL SELECT page_id, 'warning', 'video_fps' FROM pages WHERE page_id % 4 = 0)""")
def stream_issues(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("episode_id"), F.col("url").alias("stream"), (F.col("page_id") % 7).alias("n_bytes"), (F.col("page_id") % 4).cast("double").alias("fps"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    counts = rows.select("episode_id", "stream", F.lit(10).alias("frame_count_attr"), (F.col("episode_id") % 3 + 10).alias("n_decoded"))
    rates = integrity.video_rate_rule(rows.select("episode_id", F.col("fps").alias("video_fps")))
    return integrity.gathered(integrity.stream_rules(rows), integrity.decoded_count_rule(counts, 1), rates).select("episode_id", "severity", "code")


@query(f"WITH {FRAMES} SELECT episode_id, frame_index, round(coalesce(lead(value) OVER w - value, 0), 6) AS delta FROM f WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index)")
def forward_delta(spark, d):
    return frames(spark, d).select("episode_id", "frame_index", r6(actions.forward_delta(F.col("value"))).alias("delta"))


@query(f"WITH {FRAMES} SELECT episode_id, frame_index, round(coalesce(lead(value) OVER w, value) - value, 6) AS delta FROM f WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index)")
def append_last_delta(spark, d):
    return frames(spark, d).select("episode_id", "frame_index", r6(actions.appended_delta(F.col("value"))).alias("delta"))


@query(f"WITH {VECTORS}, p AS (SELECT *, list_sum(list_transform(v, lambda x: abs(x))) AS pressure FROM e) SELECT episode_id, vec_id, round(coalesce(abs(pressure - lag(pressure) OVER (PARTITION BY episode_id ORDER BY frame_index)), 0), 6) AS slip FROM p")
def slip_score(spark, d):
    rows = vectors(spark, d).withColumn("p", F.aggregate(F.transform("v", lambda x: F.abs(x)), F.lit(0.0), lambda s, x: s + x))
    return rows.select("episode_id", "vec_id", r6(actions.slip(F.col("p"))).alias("slip"))


@query(f"WITH {FRAMES}, g AS (SELECT *, lag(value) OVER (PARTITION BY episode_id ORDER BY frame_index) AS b FROM f) SELECT episode_id, frame_index FROM g WHERE b < 50 AND value >= 50")
def rising_edges(spark, d):
    rows = frames(spark, d).withColumn("_e", actions.rising_edge(F.col("value"), F.lit(50.0)))
    return rows.where("_e").select("episode_id", "frame_index")


@query(f"""WITH {FRAMES}, g AS (SELECT *, coalesce(lead(value) OVER w - value, 0) AS dv, first_value(value) OVER w AS v0 FROM f WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index))
SELECT episode_id, frame_index, round(v0 + coalesce(sum(dv) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 5) AS replayed FROM g""")
def delta_replay(spark, d):
    rows = frames(spark, d).withColumn("dv", actions.forward_delta(F.col("value"))).withColumn("v0", F.first("value").over(by_episode()))
    return rows.select("episode_id", "frame_index", F.round(actions.replayed(F.col("v0"), F.col("dv")), 5).alias("replayed"))


def _half(v: str) -> str:
    """SQL of the unit quaternion [w, x, y, z] of a rotation vector in slots 4 to 6 of v."""
    size = f"sqrt({v}[4] * {v}[4] + {v}[5] * {v}[5] + {v}[6] * {v}[6])"
    return f"list_concat([cos({size} / 2)], list_transform([{v}[4], {v}[5], {v}[6]], lambda c: CASE WHEN {size} = 0 THEN 0.0 ELSE c * sin({size} / 2) / {size} END))"


@query(f"""WITH {LINES}, c AS (SELECT *, list_transform(range(1, 8), lambda i: CASE WHEN i = 7 THEN gripper / 2 ELSE state[i] * 3 - 0.25 * i END) AS rec FROM n),
s AS (SELECT *, lead(state, 1, state) OVER w AS nx, lead(rec, 1, rec) OVER w AS nr FROM c WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index)),
q AS (SELECT *, {_half('nx')} AS b, {_half('state')} AS a FROM s),
h AS (SELECT *, b[1] * a[1] + b[2] * a[2] + b[3] * a[3] + b[4] * a[4] AS qw,
  b[2] * a[1] - b[1] * a[2] - b[3] * a[4] + b[4] * a[3] AS qx,
  b[3] * a[1] - b[1] * a[3] - b[4] * a[2] + b[2] * a[4] AS qy,
  b[4] * a[1] - b[1] * a[4] - b[2] * a[3] + b[3] * a[2] AS qz FROM q),
t AS (SELECT *, sqrt(qx * qx + qy * qy + qz * qz) AS qn FROM h),
u AS (SELECT *, CASE WHEN qn < 1e-12 THEN 2.0 ELSE 2 * atan2(qn * sign(qw), abs(qw)) / qn END AS k FROM t),
d AS (SELECT episode_id, frame_index, m.mode, CASE m.mode
  WHEN 'ee_delta_6d_gripper' THEN [nx[1] - state[1], nx[2] - state[2], nx[3] - state[3], k * qx, k * qy, k * qz, gripper]
  WHEN 'ee_absolute_6d_gripper' THEN list_append(rec[1:6], gripper)
  WHEN 'joint_position_gripper' THEN rec
  ELSE list_append(list_transform(range(1, 7), lambda i: nr[i] - rec[i]), gripper) END AS action
  FROM u, (VALUES ('ee_delta_6d_gripper'), ('ee_absolute_6d_gripper'), ('joint_position_gripper'), ('joint_delta_gripper')) m(mode))
SELECT episode_id, frame_index, mode, (i - 1)::INT AS dim, round(action[i], 6) + 0.0 AS x FROM d, range(1, 8) r(i)""")
def action_modes(spark, d):
    """Four actions for each frame; the recorded action is made up from the state."""
    recorded = F.concat(F.transform("state", lambda x, i: x * 3 - (i + 1) * 0.25), F.array(F.col("gripper") / 2))
    rows = lines(spark, d).withColumn("rec", recorded)
    made = [F.struct(F.lit(m).alias("mode"), actions.build_action(m, F.col("state"), F.col("rec"), F.col("gripper")).alias("action")) for m in actions.MODES]
    out = rows.select("episode_id", "frame_index", F.array(*made).alias("made")).select("episode_id", "frame_index", F.inline("made"))
    return out.select("episode_id", "frame_index", "mode", F.posexplode("action").alias("dim", "x")).withColumn("x", r6("x") + 0.0)


@query(f"""WITH {LINES}, a AS (SELECT episode_id, frame_index, list_append(list_transform(state, lambda x: x - 0.3), gripper * 2 - 0.5) AS v FROM n)
SELECT episode_id, frame_index, (i - 1)::INT AS dim, round(CASE WHEN i <= 3 THEN greatest(least(v[i], 0.05), -0.05) WHEN i <= 6 THEN greatest(least(v[i], 0.35), -0.35) ELSE greatest(least(v[i], 1.0), 0.0) END, 6) AS x FROM a, range(1, 8) r(i)""")
def clip_actions(spark, d):
    action = F.concat(F.transform("state", lambda x: x - 0.3), F.array(F.col("gripper") * 2 - 0.5))
    rows = lines(spark, d).select("episode_id", "frame_index", F.posexplode(vec.clip_slots(action)).alias("dim", "x"))
    return rows.withColumn("x", r6("x"))


@query(f"""WITH {LINES}, s AS (SELECT *, lag(state, 1, state) OVER (PARTITION BY episode_id ORDER BY frame_index) AS cur FROM n)
SELECT episode_id, frame_index, sqrt(list_sum(list_transform(range(1, 4), lambda k: (state[k] - cur[k]) * (state[k] - cur[k])))) > 0.5 AS too_big, (i - 1)::INT AS dim, round(greatest(least(state[i], cur[i] + 0.1), cur[i] - 0.1), 6) AS x FROM s, range(1, 7) r(i)""")
def safe_clip(spark, d):
    rows = lines(spark, d).withColumn("cur", F.coalesce(F.lag("state").over(by_episode()), F.col("state")))
    big = vec.distance(F.slice("state", 1, 3), F.slice("cur", 1, 3)) > 0.5
    out = rows.select("episode_id", "frame_index", big.alias("too_big"), F.posexplode(vec.clip_around(F.col("state"), F.col("cur"), 0.1)).alias("dim", "x"))
    return out.withColumn("x", r6("x"))


@query(f"""WITH {LINES}, a AS (SELECT episode_id, frame_index, state, list_transform(range(1, 7), lambda i: state[i] * 0.1) AS dl FROM n)
SELECT episode_id, frame_index, (i - 1)::INT AS dim, round(CASE WHEN i % 2 = 1 THEN dl[i] + state[i] ELSE dl[i] END, 6) AS x FROM a, range(1, 7) r(i)""")
def delta_to_absolute(spark, d):
    rows = lines(spark, d).withColumn("dl", F.transform("state", lambda x: x * 0.1))
    out = rows.select("episode_id", "frame_index", F.posexplode(vec.to_absolute(F.col("dl"), F.col("state"), [True, False] * 3)).alias("dim", "x"))
    return out.withColumn("x", r6("x"))


@query(f"""WITH {LINES}, a AS (SELECT episode_id, frame_index, list_append(state, gripper) AS fv FROM n)
SELECT episode_id, frame_index, round(fv[7], 6) AS gripper, round(list_sum(fv[1:3]), 6) AS left_sum, round(list_sum(list_append(fv, 0.0)[5:8]), 6) AS right_sum, 10 AS width, round(coalesce(fv[7], 0) + coalesce(fv[3], 0), 6) AS picked FROM a""")
def state_vectors(spark, d):
    full = vec.with_gripper(F.col("state"), F.col("gripper"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    rows = lines(spark, d).withColumn("full", full).withColumn("even", vec.padded(F.col("full"), 8))
    picked = F.aggregate(vec.taken(F.col("full"), [6, 2, 40]), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    three = F.slice(vec.first_half(F.col("even")), 1, 3)
    return rows.select("episode_id", "frame_index", r6(F.element_at("full", 7)).alias("gripper"), r6(add(three)).alias("left_sum"), r6(add(vec.second_half(F.col("even")))).alias("right_sum"), F.size(vec.padded(F.col("full"), 10)).alias("width"), r6(picked).alias("picked"))


@query(f"WITH {LINES}, m AS (SELECT episode_id, frame_index, list_max(list_transform(state[1:3], lambda x: abs(x))) AS m FROM n) SELECT episode_id, frame_index, round(m, 6) AS m FROM m WHERE m > 0.9")
def unsafe_actions(spark, d):
    rows = lines(spark, d).withColumn("m", vec.largest_move(F.col("state")))
    return rows.where("m > 0.9").select("episode_id", "frame_index", r6("m").alias("m"))
