"""Statistics, normalisation, training windows and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import signals
from frameloom.functions import vectors as vec
from frameloom.operators import evaluation as ev
from frameloom.operators import stats, windows
from frameloom.operators.episodes import by_episode, episode_lengths
from frameloom.operators.integrity import steps

from .motion_queries import DT
from .registry import FRAMES, LINES, VECTORS, frames, lines, query, r6, table, vectors

ELEMENTS = VECTORS + ", x AS (SELECT episode_id, vec_id, (i - 1)::INT AS dim, v[i] AS x FROM e, range(1, 65) r(i))"
STATS = ELEMENTS + ", st AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1)"


def _elements(spark, d):
    return stats.long_form(vectors(spark, d), "v", "episode_id", "vec_id")


@query(f"WITH {STATS} SELECT dim, round(lo, 6) AS lo, round(hi, 6) AS hi FROM st")
def norm_minmax(spark, d):
    out = stats.refuse_large(stats.min_max(_elements(spark, d)))
    return out.select("dim", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(f"WITH {ELEMENTS} SELECT dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM x GROUP BY 1")
def norm_meanstd(spark, d):
    return stats.mean_std(_elements(spark, d)).select("dim", *[r6(c).alias(c) for c in ("mean", "std", "lo", "hi")])


@query(f"""WITH {LINES}, x AS (SELECT (i - 1)::INT AS dim, CASE WHEN i = 2 AND frame_index = 1 THEN 'nan'::DOUBLE WHEN i = 3 AND frame_index = 2 THEN 'inf'::DOUBLE WHEN i = 4 AND frame_index = 0 THEN NULL ELSE state[i] END AS x FROM n, range(1, 7) r(i))
SELECT dim, round(min(x) FILTER (WHERE NOT isnan(x)), 6) AS lo, CASE WHEN bool_or(isinf(x)) THEN NULL ELSE round(avg(x) FILTER (WHERE NOT isnan(x) AND NOT isinf(x)), 9) END AS mean, coalesce(bool_or(isnan(x)), false) AS has_nan, coalesce(bool_or(isinf(x)), false) AS has_inf FROM x GROUP BY 1""")
def nan_aware_stats(spark, d):
    rows = stats.long_form(lines(spark, d), "state", "frame_index")
    at = lambda dim, frame: (F.col("dim") == dim) & (F.col("frame_index") == frame)
    x = F.when(at(1, 1), F.lit(float("nan"))).when(at(2, 2), F.lit(float("inf"))).when(at(3, 0), F.lit(None).cast("double")).otherwise(F.col("x"))
    out = stats.nan_aware(rows.withColumn("x", x))
    return out.select("dim", r6("lo").alias("lo"), F.when(~F.col("has_inf"), F.round("mean", 9)).alias("mean"), "has_nan", "has_inf")


@query(f"WITH {STATS} SELECT vec_id, dim, round((x - lo) / (hi - lo + 1e-8::DOUBLE) * 2 - 1, 6) AS y FROM x JOIN st USING (dim)")
def normalise(spark, d):
    rows = vectors(spark, d).select("vec_id", "v")
    out = stats.normalise_vectors(rows, "v", stats.min_max(stats.long_form(rows, "v")))
    return out.select("vec_id", F.posexplode("y").alias("dim", "y")).withColumn("y", r6("y"))


@query(f"WITH {ELEMENTS} SELECT vec_id, dim, round(x, 6) AS back FROM x")
def normalise_roundtrip(spark, d):
    rows = vectors(spark, d).select("vec_id", "v")
    bounds = stats.min_max(stats.long_form(rows, "v"))
    out = stats.denormalise_vectors(stats.normalise_vectors(rows, "v", bounds), "y", bounds)
    return out.select("vec_id", F.posexplode("back").alias("dim", "back")).withColumn("back", r6("back"))


@query(f"""WITH {STATS} SELECT dim, round(CASE WHEN dim BETWEEN 6 AND 11 OR dim BETWEEN 18 AND 23 THEN 5.0 ELSE lo END, 6) AS lo,
round(CASE WHEN dim IN (10, 22) THEN 90.0 WHEN dim IN (11, 23) THEN 120.0 WHEN dim BETWEEN 6 AND 9 OR dim BETWEEN 18 AND 21 THEN 110.0 ELSE hi END, 6) AS hi FROM st""")
def override_ranges(spark, d):
    out = stats.override_ranges(stats.min_max(_elements(spark, d)), stats.hand_slots())
    return out.select("dim", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(f"""WITH {LINES}, s AS (SELECT *, lead(state) OVER (PARTITION BY episode_id ORDER BY frame_index) AS nx FROM n),
p AS (SELECT i AS axis, state[i] * 2 + gripper / 100 AS a, nx[i] - state[i] AS dl FROM s, range(1, 4) r(i) WHERE nx IS NOT NULL)
SELECT (axis - 1)::INT AS axis, round(CASE WHEN stddev_pop(a) >= 1e-8 AND stddev_pop(dl) >= 1e-8 THEN covar_pop(a, dl) / (stddev_pop(a) * stddev_pop(dl)) END, 6) AS corr, round(avg(abs(dl)), 6) AS mean_abs_delta FROM p GROUP BY 1""")
def action_state_corr(spark, d):
    rows = lines(spark, d).withColumn("nx", F.lead("state").over(by_episode())).where("nx is not null")
    axes = F.array(*[F.struct(F.lit(i).alias("axis"), (F.col("state")[i] * 2 + F.col("gripper") / 100).alias("a"), (F.col("nx")[i] - F.col("state")[i]).alias("dl")) for i in range(3)])
    out = rows.select(F.inline(axes)).groupBy("axis").agg(stats.safe_corr(F.col("a"), F.col("dl")).alias("corr"), F.avg(F.abs("dl")).alias("mean_abs_delta"))
    return out.select("axis", r6("corr").alias("corr"), r6("mean_abs_delta").alias("mean_abs_delta"))


@query(f"""WITH {LINES}, k AS (SELECT sqrt(list_sum(list_transform(state[1:3], lambda x: x * x))) AS xyz, sqrt(list_sum(list_transform(state[4:6], lambda x: x * x))) AS rot, gripper * 1.2 AS g FROM n)
SELECT count(*) FILTER (WHERE xyz > 0.10) AS large_xyz, count(*) FILTER (WHERE rot > 0.75) AS large_rot, count(*) FILTER (WHERE g < -0.05 OR g > 1.05) AS gripper_out FROM k""")
def outlier_counts(spark, d):
    return stats.outlier_counts(lines(spark, d), vec.norm(F.slice("state", 1, 3)), vec.norm(F.slice("state", 4, 3)), F.col("gripper") * 1.2)


@query("SELECT round(quantile_cont(value, 0.01) FILTER (WHERE value > 0), 6) AS p1, round(quantile_cont(value, 0.99) FILTER (WHERE value > 0), 6) AS p99 FROM events")
def depth_percentiles(spark, d):
    return stats.display_range(table(spark, d, "events"), "value").select(r6("p1").alias("p1"), r6("p99").alias("p99"))


@query(f"""WITH {DT} SELECT episode_id, coalesce(greatest(1.0, round_even(1.0 / avg(dt) FILTER (WHERE dt > 0), 0)), 10.0)::DOUBLE AS fps, round(coalesce(least(greatest(1.0 / median(dt) FILTER (WHERE dt > 0), 1.0), 120.0), 15.0), 6)::DOUBLE AS video_fps FROM s GROUP BY 1""")
def infer_fps(spark, d):
    out = stats.inferred_fps(steps(frames(spark, d)))
    return out.withColumn("video_fps", r6("video_fps"))


@query(f"WITH {FRAMES} SELECT episode_id, round(min(value) - CASE WHEN max(value) - min(value) > 1e-9 THEN (max(value) - min(value)) * 0.1 ELSE 0.5 END, 6) AS lo, round(max(value) + CASE WHEN max(value) - min(value) > 1e-9 THEN (max(value) - min(value)) * 0.1 ELSE 0.5 END, 6) AS hi FROM f GROUP BY 1")
def plot_bounds(spark, d):
    return stats.plot_bounds(frames(spark, d), "value", "episode_id").select("episode_id", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(f"WITH {FRAMES} SELECT episode_id, round(avg(value), 6) AS avg_hz, max(value) AS max_hz, min(value) AS min_hz, round(stddev_pop(value), 6) AS std_hz FROM f WHERE frame_index > 0 GROUP BY 1")
def rate_summary(spark, d):
    rates = frames(spark, d).select("episode_id", F.col("frame_index").alias("step"), F.col("value").alias("hz"))
    return stats.rate_summary(rates).withColumn("avg_hz", r6("avg_hz")).withColumn("std_hz", r6("std_hz"))


@query("SELECT event_type, round(coalesce(min(value) FILTER (WHERE value > 10), 0), 6) AS lo, round(coalesce(max(value) FILTER (WHERE value > 10), 0), 6) AS hi, round(coalesce(avg(value) FILTER (WHERE value > 10), 0), 6) AS mean FROM events GROUP BY 1")
def motion_summary(spark, d):
    rows = table(spark, d, "events").withColumn("m", F.when(F.col("value") > 10, F.col("value")))
    return stats.motion_summary(rows, "event_type", "m").select("event_type", r6("lo").alias("lo"), r6("hi").alias("hi"), r6("mean").alias("mean"))


ENDS = FRAMES + ", l AS (SELECT episode_id, count(*) AS n_frames FROM f GROUP BY 1), ends AS (SELECT episode_id, n_frames, sum(n_frames) OVER (ORDER BY episode_id)::BIGINT AS episode_end FROM l)"
PRED, OBS, ACT = 8, 2, 4
SAMPLES = (
    ENDS
    + """, si AS (SELECT episode_id, n_frames, episode_end - n_frames AS base, unnest(generate_series(-1, n_frames - 8 + 3)) AS idx FROM ends WHERE n_frames - 8 + 3 >= -1)"""
)


@query(f"WITH {ENDS} SELECT * FROM ends")
def episode_ends(spark, d):
    return windows.episode_ends(episode_lengths(frames(spark, d)).select("episode_id", "n_frames"))


def _samples(spark, d):
    return windows.sample_indices(episode_ends(spark, d), PRED, OBS, ACT)


@query(f"""WITH {SAMPLES} SELECT episode_id, idx, greatest(idx, 0) + base AS buffer_start, least(idx + 8, n_frames) + base AS buffer_end, greatest(idx, 0) - idx AS sample_start, least(idx + 8, n_frames) - idx AS sample_end FROM si""")
def sample_indices(spark, d):
    return _samples(spark, d).drop("n_frames")


WINDOWS = SAMPLES + ", sw AS (SELECT si.episode_id, idx, s.step::INT AS step, greatest(0, least(idx + s.step, n_frames - 1)) AS frame_index, s.step < 2 AS observed FROM si, range(0, 8) s(step))"


@query(f"WITH {WINDOWS} SELECT episode_id, idx, step, frame_index, observed, value FROM sw JOIN f USING (episode_id, frame_index)")
def sample_windows(spark, d):
    return windows.sample_windows(_samples(spark, d), frames(spark, d), PRED, OBS, "value").select("episode_id", "idx", "step", "frame_index", "observed", "value")


@query(f"WITH {WINDOWS} SELECT episode_id, idx, string_agg(round(value, 2)::VARCHAR, ',' ORDER BY step) AS window FROM (SELECT sw.*, frame_index * 1.0::DOUBLE AS value FROM sw) WHERE observed GROUP BY 1, 2")
def observation_windows(spark, d):
    rows = windows.sample_windows(_samples(spark, d), frames(spark, d).withColumn("x", F.col("frame_index").cast("double")), PRED, OBS, "x").where("observed")
    return windows.stacked(rows, "x").select("episode_id", "idx", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("window"))


@query(f"""WITH {FRAMES}, c AS (SELECT episode_id, frame_index AS chunk_at, list(value) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS chunk FROM f)
SELECT episode_id, chunk_at, (i - 1)::INT AS step, chunk[i] AS value FROM c, range(1, 5) r(i) WHERE chunk_at % 4 = 0 AND i <= len(chunk)""")
def action_chunks(spark, d):
    return windows.action_chunks(frames(spark, d), "value", PRED, ACT)


@query(f"WITH {FRAMES}, k AS (SELECT *, frame_index // 4 AS block, count(*) OVER (PARTITION BY episode_id) AS n FROM f) SELECT episode_id, frame_index, block FROM k WHERE block * 4 < n - 4")
def eval_roll_blocks(spark, d):
    return windows.eval_blocks(frames(spark, d), ACT).select("episode_id", "frame_index", "block")


@query(f"WITH {ENDS}, m AS (SELECT episode_id, n_frames, least(7, n_frames) AS m FROM l) SELECT episode_id, i, CASE WHEN m > 1 THEN floor(i * (n_frames - 1) / (m - 1)::DOUBLE) ELSE 0 END::BIGINT AS frame_index FROM m, range(0, 7) r(i) WHERE i < m")
def even_sample(spark, d):
    return windows.even_sample(episode_lengths(frames(spark, d)).select("episode_id", "n_frames"), 7)


@query("""WITH m AS (SELECT vec_id AS id, embedding[1:3]::DOUBLE[] AS a, embedding[4:6]::DOUBLE[] AS b FROM embeddings),
k AS (SELECT *, least(floor(list_max(list_transform(range(1, 4), lambda i: abs(b[i] - a[i]))) / 0.01::DOUBLE), 20)::INT AS n FROM m)
SELECT id, s.step::INT AS step, round(a[1] + (b[1] - a[1]) * CASE WHEN n > 1 THEN s.step / (n - 1)::DOUBLE ELSE 0 END, 6) AS x FROM k, range(0, 20) s(step) WHERE s.step < n""")
def interpolated_path(spark, d):
    moves = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 3).cast("array<double>").alias("a"), F.slice("embedding", 4, 3).cast("array<double>").alias("b"))
    return windows.interpolated_path(moves, "a", "b").select("id", "step", r6(F.col("point")[0]).alias("x"))


PRED_SQL = """p AS (SELECT *, lead(value) OVER (PARTITION BY episode_id ORDER BY frame_index) AS target, avg(value) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS pred,
 frame_index / greatest(max(frame_index) OVER (PARTITION BY episode_id), 1)::DOUBLE AS progress FROM f),
q AS (SELECT *, CASE WHEN progress < 0.3 THEN 'early' WHEN progress < 0.6 THEN 'middle' ELSE 'late' END AS phase FROM p WHERE target IS NOT NULL)"""


def _predicted(spark, d):
    rows = ev.progress(frames(spark, d)).withColumn("target", F.lead("value").over(by_episode()))
    return rows.withColumn("pred", F.avg("value").over(by_episode().rowsBetween(-4, 0))).where("target is not null")


@query(f"""WITH {FRAMES}, {PRED_SQL}, o AS (SELECT phase, (pred - target) * (pred - target) * (1 + frame_index % 2) AS sse, 1 + frame_index % 2 AS n FROM q)
SELECT phase, count(*) AS samples, round(sum(sse) / sum(n), 5) AS mse, round(sqrt(sum(sse) / sum(n)), 6) AS rmse, round(avg(sse / n), 5) AS mean_sample_mse, round(median(sse / n), 5) AS median_sample_mse, round(quantile_cont(sse / n, 0.9), 5) AS p90_sample_mse FROM o GROUP BY GROUPING SETS ((), (phase))""")
def mse_by_phase(spark, d):
    n = 1 + F.col("frame_index") % 2
    rows = _predicted(spark, d).select("phase", (ev.squared_error(F.col("pred"), F.col("target")) * n).alias("sse"), n.alias("n"))
    out = ev.mse_by_phase(rows)
    return out.select("phase", "samples", *[F.round(c, 6 if c == "rmse" else 5).alias(c) for c in ("mse", "rmse", "mean_sample_mse", "median_sample_mse", "p90_sample_mse")])


@query(f"WITH {FRAMES}, {PRED_SQL} SELECT episode_id, round(avg(abs(pred - target)), 6) AS mae, round(avg(abs(target - value)), 6) AS mean_abs_change FROM q GROUP BY 1")
def mae_per_episode(spark, d):
    rows = _predicted(spark, d).withColumn("change", F.col("target") - F.col("value"))
    return ev.mae(rows, "pred", "target", "change").select("episode_id", r6("mae").alias("mae"), r6("mean_abs_change").alias("mean_abs_change"))


@query(f"WITH {FRAMES}, {PRED_SQL} SELECT round(avg(e), 5) AS mean_of_means FROM (SELECT avg((pred - target) * (pred - target)) AS e FROM q GROUP BY episode_id)")
def mean_of_means(spark, d):
    rows = _predicted(spark, d)
    return ev.mean_of_means(rows, ev.squared_error(F.col("pred"), F.col("target"))).select(F.round("mean_of_means", 5).alias("mean_of_means"))


@query(f"WITH {LINES} SELECT (i - 1)::INT AS dim, round(avg((state[i] - gripper) * (state[i] - gripper)), 6) AS mse FROM n, range(1, 7) r(i) GROUP BY 1")
def mse_by_dim(spark, d):
    rows = lines(spark, d).select("gripper", F.posexplode("state").alias("dim", "x"))
    return ev.mse_by_dim(rows, "x", "gripper").select("dim", r6("mse").alias("mse"))


@query("SELECT r_name AS checkpoint, s_suppkey AS sample FROM region, supplier")
def checkpoint_grid(spark, d):
    return ev.against_all(table(spark, d, "region").select(F.col("r_name").alias("checkpoint")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample")))


@query(f"""WITH {VECTORS}, a AS (SELECT *, list_transform(v, lambda x: abs(x)) AS a FROM e), s AS (SELECT *, list_sum(a) AS total, list_sum(v) / 64 AS mean FROM a)
SELECT vec_id, (total > 1e-5)::INT AS contact, round(mean, 6) AS mean, round(sqrt(list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / 64), 6) AS std,
 round(coalesce(abs(total - lag(total) OVER (PARTITION BY episode_id ORDER BY frame_index)), 0), 6) AS slip, round(list_sum(a[1:32]) / 32, 6) AS left_mean, round(list_sum(a[33:64]) / 32, 6) AS right_mean, round(total, 6) AS total,
 round(list_sum(list_transform(range(1, 65), lambda i: a[i] * (i - 1))) / greatest(total, 1e-6) / 63, 6) AS centre FROM s""")
def tactile_features(spark, d):
    rows = vectors(spark, d).withColumn("t", signals.tactile_features(F.col("v"), "episode_id", ["frame_index"]))
    names = ("contact", "mean", "std", "slip", "left_mean", "right_mean", "total", "centre")
    return rows.select("vec_id", *[(F.col("t")[i].cast("int") if c == "contact" else r6(F.col("t")[i])).alias(c) for i, c in enumerate(names)])


@query(f"WITH {VECTORS} SELECT vec_id, len(list_filter(v, lambda x: x * 10000 > 1000))::INT AS touched FROM e")
def binarise_touch(spark, d):
    touched = F.aggregate(vec.binarised(F.transform("v", lambda x: x * 10000)), F.lit(0.0), lambda s, x: s + x)
    return vectors(spark, d).select("vec_id", touched.cast("int").alias("touched"))


@query(f"""WITH {VECTORS} SELECT vec_id, (i - 1)::INT AS dim, round((CASE WHEN i = 6 THEN -v[i] ELSE v[i] END * 100 - 5) / (CASE i WHEN 5 THEN 85.0 WHEN 6 THEN 115.0 ELSE 105.0 END), 6) AS x FROM e, range(1, 7) r(i)""")
def hand_to_unit(spark, d):
    hand = F.transform(F.slice("v", 1, 6), lambda x: x * 100)
    rows = vectors(spark, d).select("vec_id", F.posexplode(vec.hand_to_unit(hand, stats.HAND_LOW, stats.HAND_HIGH)).alias("dim", "x"))
    return rows.withColumn("x", r6("x"))


@query("""WITH k AS (SELECT event_id, (event_id * 37) % 9001 AS mm FROM events),
c AS (SELECT *, CASE WHEN mm > 0 THEN floor((greatest(least(mm::DOUBLE, 1500.0), 200.0) - 200.0) * 255.0 / 1300.0) ELSE 0 END::INT AS code FROM k)
SELECT event_id, code, round(CASE WHEN code > 0 THEN code / 255.0::DOUBLE * 1300.0 + 200.0 ELSE 0.0 END, 6) AS depth, CASE WHEN mm > CASE WHEN event_id % 2 = 0 THEN 800 ELSE 8000 END THEN mm ELSE 0 END AS beyond FROM c""")
def depth_codes(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") * 37 % 9001).alias("mm"))
    code = signals.depth_code(F.col("mm"))
    return rows.select("event_id", code.alias("code"), r6(signals.depth_of(code)).alias("depth"), signals.keep_beyond(F.col("mm"), F.col("event_id") % 2).alias("beyond"))


@query("""WITH k AS (SELECT event_id, value / 4 AS m FROM events), z AS (SELECT event_id, m, greatest(least((m - 0.5) / 19.5, 1.0), 0.0) AS x FROM k),
g AS (SELECT event_id, CASE WHEN m <= 0.5 THEN 0.0 WHEN x <= 0.15 THEN 0.0 WHEN x <= 0.45 THEN 0.3 WHEN x <= 0.75 THEN 0.6 ELSE 1.0 END::DOUBLE AS force FROM z)
SELECT event_id, force, CASE WHEN force <= 1e-6 THEN 'off' WHEN force >= 1.0 - 1e-6 THEN 'firm' WHEN force >= 0.6 - 1e-6 THEN 'mild' WHEN force >= 0.3 - 1e-6 THEN 'soft' ELSE 'active' END AS state, printf('%.4f %.4f', force, 1.0::DOUBLE) AS packet FROM g""")
def force_levels(spark, d):
    force = signals.motion_to_force(F.col("value") / 4)
    rows = table(spark, d, "events").select("event_id", force.cast("double").alias("force"))
    return rows.select("event_id", "force", signals.force_state(F.col("force")).alias("state"), signals.packet(F.col("force"), F.lit(1.0)).alias("packet"))


@query("""WITH k AS (SELECT event_id, event_id / 100.0::DOUBLE AS t FROM events), p AS (SELECT *, (t * 0.5) - floor(t * 0.5) AS p FROM k)
SELECT event_id, round(0.2 + 0.6 * (0.5 + 0.5 * sin(2 * pi() * (t * 0.5))), 6) AS sine, round(0.2 + 0.6 * CASE WHEN p < 0.25 THEN 0.5 + 2 * p WHEN p < 0.75 THEN 1 - 2 * (p - 0.25) ELSE 2 * (p - 0.75) END, 6) AS triangle FROM p""")
def waves(spark, d):
    t = F.col("event_id") / F.lit(100.0)
    rows = table(spark, d, "events")
    return rows.select("event_id", r6(signals.wave("sine", t, 0.5, 0.2, 0.8)).alias("sine"), r6(signals.wave("triangle", t, 0.5, 0.2, 0.8)).alias("triangle"))


@query("""WITH r AS (SELECT page_id % 10 AS image_id, page_id, page_id % 17 + 1 AS area, page_id % 5 AS top, page_id % 5 + page_id % 9 AS bottom, 0 AS "left", 4 AS "right" FROM pages),
m AS (SELECT image_id, median(area) AS med FROM r GROUP BY 1)
SELECT image_id, page_id FROM r JOIN m USING (image_id) WHERE med > 0 AND area BETWEEN med * 0.25 AND med * 4.0 AND greatest(greatest(1, "right" - "left") / greatest(1, bottom - top)::DOUBLE, greatest(1, bottom - top) / greatest(1, "right" - "left")::DOUBLE) <= 3.0""")
def marker_filter(spark, d):
    from frameloom.functions.images import marker_filter as keep

    k = F.col("page_id")
    rows = table(spark, d, "pages").select((k % 10).alias("image_id"), "page_id", (k % 17 + 1).alias("area"), (k % 5).alias("top"), (k % 5 + k % 9).alias("bottom"), F.lit(0).alias("left"), F.lit(4).alias("right"))
    return keep(rows).select("image_id", "page_id")


@query(f"""WITH {VECTORS}, dd AS (SELECT vec_id, episode_id, list_transform(range(1, 65), lambda i: v[i] - (first_value(v) OVER (PARTITION BY episode_id ORDER BY frame_index))[i]) AS dv FROM e) SELECT vec_id, round(list_sum(dv), 6) AS total FROM dd""".replace("list_transform(range(1, 65), lambda i: v[i] - (first_value(v) OVER (PARTITION BY episode_id ORDER BY frame_index))[i]) AS dv FROM e", "[v[i] - w[i] for i in range(1, 65)] AS dv FROM (SELECT *, first_value(v) OVER (PARTITION BY episode_id ORDER BY frame_index) AS w FROM e)"))
def reference_delta(spark, d):
    from frameloom.operators.actions import from_first

    rows = vectors(spark, d)
    return rows.withColumn("dv", from_first(rows, "v")).select("vec_id", r6(F.aggregate("dv", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(f"""WITH {VECTORS}, w AS (SELECT *, first_value(v) OVER (PARTITION BY episode_id ORDER BY frame_index) AS w FROM e),
p AS (SELECT vec_id, v[2 * i - 1] - w[2 * i - 1] AS dx, v[2 * i] - w[2 * i] AS dy FROM w, range(1, 33) r(i)), m AS (SELECT vec_id, median(dx) AS mx, median(dy) AS my FROM p GROUP BY 1)
SELECT vec_id, round(sum(greatest(sqrt((dx - mx) * (dx - mx) + (dy - my) * (dy - my)) - 0.05, 0)), 6) AS motion FROM p JOIN m USING (vec_id) GROUP BY 1""")
def marker_motion(spark, d):
    from frameloom.functions.images import marker_motion as motion
    from frameloom.operators.actions import from_first

    rows = vectors(spark, d)
    dv = rows.withColumn("dv", from_first(rows, "v")).select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("dv", i * 2).alias("dx"), F.get("dv", i * 2 + 1).alias("dy")))).alias("p")).select("vec_id", "p.*")
    drift = dv.groupBy("vec_id").agg(F.median("dx").alias("mx"), F.median("dy").alias("my"))
    out = dv.join(drift, "vec_id").groupBy("vec_id").agg(F.sum(motion(F.col("dx"), F.col("dy"), F.col("mx"), F.col("my"), 0.05)).alias("motion"))
    return out.select("vec_id", r6("motion").alias("motion"))
