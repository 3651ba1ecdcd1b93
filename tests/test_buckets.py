"""Many episodes under one key of the state: each keeps a state of its own, which is read and written once a trigger."""

import pandas as pd
import pytest

from frameloom.streaming import buckets
from frameloom.streaming import operators as st
from frameloom.streaming import timed as tm


class Value:
    def __init__(self):
        self.row, self.calls = None, 0

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row, self.calls = row, self.calls + 1

    def clear(self):
        self.row = None


class Handle:
    """What a processor asks of Spark, in memory."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def getValueState(self, name, schema, ttl=None):
        return self.values.setdefault(name, Value())

    def listTimers(self):
        return sorted(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.fixture
def run():
    def begin(processor, bucket=0):
        handle = Handle()
        processor.init(handle)
        rows = lambda frames: [tuple(None if pd.isna(x) else x for x in r) for f in frames for r in f.itertuples(index=False)]
        give = lambda **columns: rows(processor.handleInputRows((bucket,), iter([pd.DataFrame(columns)]), None))
        wait = lambda ms: rows(processor.handleExpiredTimer((bucket,), Watermark(ms), None))
        return give, wait, handle

    return begin


def test_episodes_of_a_bucket_fold_apart(run):
    give, _, handle = run(st.Fold((0.0,), lambda s, x: ((s[0] + x,), s[0] + x)))
    many = list(range(500))
    give(episode_id=many * 2, frame_index=[1] * 500 + [0] * 500, x=[1.0] * 500 + [float(e) for e in many], reset=[False] * 1000)
    assert handle.values["state"].calls == 1
    assert give(episode_id=[7, 900], frame_index=[2, 0], x=[1.0, 5.0], reset=[False, False]) == [(7, 2, 9.0), (900, 0, 5.0)]
    assert give(episode_id=[8, 499], frame_index=[2, 2], x=[0.0, 3.0], reset=[False, True]) == [(8, 2, 9.0), (499, 2, 3.0)]


def test_null_episodes_have_a_bucket(run):
    give, _, _ = run(st.Fold((0.0,), lambda s, x: ((s[0] + x,), s[0] + x)), bucket=-1)
    assert give(episode_id=[0, 0], frame_index=[1, 0], x=[1.0, 2.0], reset=[False, False]) == [(None, 0, 2.0), (None, 1, 3.0)]


def test_one_timer_serves_each_episode_at_its_time(run):
    give, wait, handle = run(tm.Clicks(10_000))
    assert give(episode_id=[1, 1, 2, 2, 3], us=[0, 4_000, 8_000, 12_000, 0]) == []
    assert handle.timers == {11}  # episode 3's: due at 10,000 us
    assert wait(15) == [(1, 0, 4_000, "save")]
    assert handle.timers == {23}
    assert give(episode_id=[2], us=[13_000]) == [(2, 8_000, 13_000, "delete")]
    assert handle.timers == set() and handle.values["state"].row is None


def test_held_rows_of_other_episodes_stay(run):
    give, wait, handle = run(tm.Latest())
    give(episode_id=[1, 1, 2], us=[1_000, 2_000, 9_000], id=[None, 5, 6], x=[4.0, None, None])
    assert wait(3) == [(1, 5, 2_000, 4.0)]
    assert wait(10) == [(2, 6, 9_000, None)] and handle.timers == set()
    give(episode_id=[1], us=[20_000], id=[7], x=[None])
    assert wait(30) == [(1, 7, 20_000, 4.0)]


def test_ticks_and_chunks_of_two_episodes(run):
    give, wait, _ = run(tm.Ticks(10_000))
    give(episode_id=[1, 2, 1], us=[5_000, 15_000, 1_000], x=[2.0, 3.0, 1.0])
    assert wait(21) == [(1, 10_000, 2.0), (1, 20_000, 2.0), (2, 20_000, 3.0)]
    give, _, _ = run(st.ChunkQueue("new"))
    assert give(episode_id=[1, 2], t=[0, 0], chunk_t=[0.0, None], values=[[1.0, 2.0], None]) == [(1, 0, 1.0), (2, 0, None)]
    assert give(episode_id=[1, 2], t=[1, 1], chunk_t=[None, 1.0], values=[None, [7.0]]) == [(1, 1, 2.0), (2, 1, 7.0)]


def test_buckets_grow_with_the_rows():
    assert [buckets.buckets_for(n) for n in (0, 100_000, 36_000_000)] == [64, 64, 720]
