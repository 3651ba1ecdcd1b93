"""Edge fixtures: empty, one frame, constant, equal times, thresholds, short episodes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import signals, text, vectors
from frameloom.operators import actions, episodes, evaluation, integrity, order, stats, trim, windows

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def make(spark):
    def frames(**by):
        rows = [(e, i, T0 + dt.timedelta(seconds=t), float(x)) for e, series in by.items() for i, (t, x) in enumerate(series)]
        return spark.createDataFrame(rows, "episode_id string, frame_index long, ts timestamp_ntz, value double")

    return frames


def ranges(f, **how):
    step = F.abs(F.lead("value").over(episodes.by_episode()) - F.col("value"))
    return {r.episode_id: (r.start, r.end) for r in trim.trim_ranges(f, step, 1.0, **how).collect()}


def brute(x, run, pad):
    moving = [abs(b - a) > 1.0 for a, b in zip(x, x[1:])]
    runs = [i for i in range(len(moving) - run + 1) if all(moving[i : i + run])]
    if not runs:
        return 0, len(x)
    return max(0, runs[0] - pad), min(len(x), runs[-1] + run + 1 + pad)


def test_trim_equals_brute_force(make):
    series = {"one": [0], "constant": [5] * 9, "threshold": [0, 1, 2, 3, 4], "pause": [0] * 6 + [2, 4, 6, 8] + [8] * 5 + [10, 12, 14] + [14] * 6, "short": [0, 3], "all": [0, 3, 6, 9, 12]}
    f = make(**{k: list(enumerate(v)) for k, v in series.items()})
    assert ranges(f, run=3, pad=1) == {k: brute(v, 3, 1) for k, v in series.items()}
    assert ranges(f, run=1, pad=0) == {k: brute(v, 1, 0) for k, v in series.items()}
    assert ranges(f.limit(0)) == {}


def test_gap_is_strict(make):
    even = [(i, 0) for i in range(11)]
    exact = [(0, 0), (0.1, 0), (0.2, 0), (1.2, 0)]
    assert integrity.gap_warnings(make(even=even, exact=exact)).count() == 0
    assert integrity.gap_warnings(make(late=[(i * 0.1, 0) for i in range(10)] + [(5, 0)])).count() == 1


def test_equal_and_decreasing_times(make):
    f = make(e=[(0, 0), (1, 0), (1, 0), (0.5, 0)])
    got = integrity.not_increasing(f, "frame_index", "ts").first()
    assert (got.n_violations, got.first, got.n_more) == (2, "2,3", 0)


def test_totals_of_nothing(make):
    t = episodes.dataset_totals(episodes.episode_lengths(make().limit(0))).first()
    assert tuple(t) == (0, 0, 0.0, 0.0, 0.0)


def test_constant_signal(make):
    f = make(e=[(i, 2) for i in range(5)])
    row = f.agg(stats.safe_corr(F.col("value"), F.col("value") * 0).alias("c")).first()
    assert row.c is None
    e = f.select(F.lit(0).alias("dim"), F.col("value").alias("x"))
    assert {r.y for r in stats.normalise(e, stats.min_max(e)).collect()} == {-1.0}


def test_one_frame(make):
    f = make(e=[(0, 3)])
    assert f.select(actions.forward_delta(F.col("value"))).first()[0] == 0.0
    assert integrity.timestep_report(f).count() == 0
    assert evaluation.progress(f).first().progress == 0.0


@pytest.mark.parametrize("n", [1, 2, 5, 7, 8, 20])
def test_window_count(spark, n):
    ends = spark.createDataFrame([(1, n, n)], "episode_id long, n_frames long, episode_end long")
    got = windows.sample_indices(ends, 8, 2, 4).collect()
    assert len(got) == max(0, n - 8 + 4 + 2 - 1)
    for r in got:
        assert r.buffer_end - r.buffer_start == r.sample_end - r.sample_start > 0
    with pytest.raises(ValueError):
        windows.sample_indices(ends, 4, 5, 1)


def test_click_boundaries(make):
    got = {r.session: r.clicks for r in order.sessions(make(e=[(0, 0), (0.49, 0), (0.99, 0), (1.2, 0), (1.3, 0)])).collect()}
    assert got == {1: 2, 2: 3}


def test_depth_codes(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 1, 200, 201, 850, 1500, 9000)], "mm int")
    code = [r[0] for r in rows.select(signals.depth_code(F.col("mm"))).collect()]
    assert code == [0, 0, 0, 0, 127, 255, 255]
    assert rows.select(signals.depth_of(F.lit(255))).first()[0] == 1500.0


def test_unsafe_action_is_clipped(spark):
    v = F.array(*[F.lit(x) for x in (1.0, -1.0, 0.2, 1.0, -1.0, 0.5, 2.0)])
    assert spark.range(1).select(vectors.clip_slots(v)).first()[0] == [0.05, -0.05, 0.05, 0.35, -0.35, 0.35, 1.0]
    with pytest.raises(Exception, match="unsafe"):
        spark.range(1).select(vectors.refuse_unsafe(v)).collect()


def test_hysteresis_holds(make):
    x = [0.0] * 5 + [0.2] + [0.0] * 40
    got = [r.gripper for r in order.gripper_hysteresis(make(e=list(enumerate(x))), "value").orderBy("frame_index").collect()]
    assert max(got[:5]) == 0 and all(v > 0.05 for v in got[8:34]) and got[-1] < 0.01


@pytest.mark.parametrize("hold", [0, 3, 30])
def test_hysteresis_equals_its_definition(hold):
    """Frame by frame from the definition, and the same in parts of any size."""
    how = order.Gripper(hold=hold)
    rng = np.random.default_rng(hold)
    x = np.clip(np.cumsum(rng.normal(0, 0.06, 600)), -0.1, 0.5)
    want, shut, last = [], None, None
    for i, v in enumerate(np.clip(x, 0, 1)):
        last = v if last is None else last
        ends = shut is not None and v <= how.open and i - shut >= hold
        if shut is not None and not ends:
            target = max(v, how.close, last)
        elif ends or v >= how.close or v <= how.open:
            target = v
        else:
            target = last
        shut = None if ends else i if shut is None and v >= how.close else shut
        last = 0.35 * target + 0.65 * last
        want.append(last)
    assert np.allclose(order.GripperFold(how)(x), want)
    fold = order.GripperFold(how)
    parts = np.split(x, sorted(rng.integers(0, 600, 40)))
    assert np.allclose([v for part in parts for v in fold(part)], want)


def test_recurrences_stream_through_batches(spark, make):
    """Episodes cut over many Arrow batches give what one batch gives."""
    frames = make(a=[(i, float(i % 7)) for i in range(40)], b=[(i, float(i % 5)) for i in range(23)])
    whole = {(r.episode_id, r.frame_index): r.smooth for r in order.asymmetric_ema(frames, "value").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        parts = {(r.episode_id, r.frame_index): r.smooth for r in order.asymmetric_ema(frames, "value").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    now, want = 0.0, {}
    for i in range(40):
        v = float(i % 7)
        now = 0.2 * now + 0.8 * v if v < now else 0.8 * now + 0.2 * v
        want["a", i] = now
    assert whole == parts and len(whole) == 63 and all(abs(whole[k] - v) < 1e-12 for k, v in want.items())


def test_action_modes(spark):
    rows = [(1, i, [float(x) for x in s], [float(x) for x in r], g) for i, (s, r, g) in enumerate([([0.0, 0, 0, 1, 0, 0], [1.0, 2, 3, 4, 5, 6, 7], 0.5), ([1.0, 2, 3, 0, 1, 0], [2.0, 2, 2, 2, 2, 2, 9], 1.0)])]
    df = spark.createDataFrame(rows, "episode_id long, frame_index long, state array<double>, rec array<double>, gripper double")
    act = lambda m, raw=F.col("rec"), g=F.col("gripper"): [r.a for r in df.withColumn("a", actions.build_action(m, F.col("state"), raw, g)).orderBy("frame_index").collect()]
    near = lambda got, want: np.allclose(got, want, atol=1e-3)
    assert near(act("ee_delta_6d_gripper"), [[1, 2, 3, -0.913, 0.913, 0.499, 0.5], [0, 0, 0, 0, 0, 0, 1]])
    assert near(act("ee_delta_6d_gripper", g=None)[0][6], 0)
    assert act("ee_absolute_6d_gripper") == [[1, 2, 3, 4, 5, 6, 0.5], [2, 2, 2, 2, 2, 2, 1]]
    assert act("ee_absolute_6d_gripper", g=None)[1][6] == 9 and act("ee_absolute_6d_gripper", raw=None, g=None)[1] == [1, 2, 3, 0, 1, 0, 0]
    assert act("joint_position_gripper") == [r[3] for r in rows] and act("joint_position_gripper", raw=None) == [r[2] for r in rows]
    assert act("joint_delta_gripper") == [[1, 0, -1, -2, -3, -4, 0.5], [0, 0, 0, 0, 0, 0, 1]]
    assert act("joint_delta_gripper", g=None)[0][6] == 7 and act("joint_delta_gripper", raw=None, g=None)[0] == [1, 2, 3, -1, 1, 0, 0]
    with pytest.raises(ValueError, match="mode"):
        actions.build_action("other", F.col("state"))


def test_names(spark):
    names = spark.createDataFrame([("f1",), ("f10",), ("f2",), ("x_failed",), ("y_hard",)], "name string")
    assert [r.name for r in episodes.list_episodes(names).orderBy("sort_key").collect()] == ["f1", "f2", "f10"]
    assert [r.name for r in episodes.list_episodes(names, prefixes="f1-q").orderBy("name").collect()] == ["f1", "f10"]
    with pytest.raises(Exception, match="truth"):
        spark.range(1).select(text.bool_word(F.lit("maybe"))).collect()


def test_not_finite_vectors(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, float("nan"), float("inf"), -2.0])], "episode_id long, frame_index long, v array<double>")
    assert integrity.not_finite_counts(rows, "v").first().n_bad == 2
    t = rows.select(signals.tactile_features(F.col("v"), "episode_id", ["frame_index"])).first()[0]
    assert t[0] == 1.0 and t[6] == 3.0 and t[3] == 0.0 and t[8] == 0.0
    e = stats.nan_aware(stats.long_form(rows, "v")).orderBy("dim").collect()
    assert [r.has_nan for r in e] == [False, True, False, False] and [r.has_inf for r in e] == [False, False, True, False]


def test_series_rules(spark):
    rows = spark.createDataFrame([("a", 10, 10, 9, 10, None), ("b", 5, 5, 5, 5, 4)], "episode_id string, n_times int, n_state int, n_action int, n_gripper int, n_tactile int")
    assert {(r.episode_id, r.code) for r in integrity.series_rule(rows).collect()} == {("a", "action_length"), ("b", "tactile_length")}
    files = spark.createDataFrame([("a", "EOFError", 5), ("b", None, 0), ("c", None, 7)], "episode_id string, error string, n_bytes int")
    assert {(r.episode_id, r.code) for r in integrity.unreadable_rule(files).collect()} == {("a", "unreadable"), ("b", "empty")}
