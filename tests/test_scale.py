"""Exact quantiles and segmented scans against plain forms; what their plans hold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import quantiles, segments
from frameloom.sources import frames as fr
from frameloom.sources import containers


@pytest.mark.parametrize(("bins", "few"), [(40, 1), (4096, 300)])
def test_quantiles_are_exact(spark, bins, few):
    rng = random.Random(bins)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(1500)],
        "hot": [1.5] * 900 + [rng.random() for _ in range(100)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(200)],
        "one": [4.0], "two": [3.0, -1e308], "odd": [math.inf, 1.0, 2.0], "tiny": [0.0, 5e-324, 1e-310, -5e-324, -0.0], None: [1.0, 2.0, 4.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("normal", None), ("normal", math.nan), ("nothing", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    ps = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {r["k"]: (r["n"], r["quantiles"]) for r in quantiles.exact_quantiles(df, "v", ps, ["k"], bins, few).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs = np.clip(vs, -1.7e308, 1.7e308)
        assert got[k][0] == len(vs)
        want = [quantile(sorted(vs), p) for p in ps]
        assert got[k][1] == pytest.approx(want, rel=1e-12), k
    assert quantiles.exact_quantiles(df.where("k = 'nothing'"), "v", [0.5]).collect() == []
    one = quantiles.exact_quantiles(df.where("k = 'normal'"), "v", [0.25]).first()
    assert one["quantiles"][0] == pytest.approx(np.quantile(groups["normal"], 0.25))


def quantile(vs, p):
    at = p * (len(vs) - 1)
    lo = math.floor(at)
    hi = min(lo + 1, len(vs) - 1)
    return vs[lo] + (vs[hi] - vs[lo]) * (at - lo)


@pytest.fixture(scope="module")
def long(spark):
    """One episode with nine tenths of 4,000 rows, several short ones, in eight segments at least."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    e = F.when(F.col("id") % 10 == 3, F.col("id") % 70).otherwise(0)
    rows = spark.range(4000).select(e.alias("episode_id"), F.col("id").alias("t"), F.when(F.hash("id") % 97 == 0, F.col("id").cast("double")).alias("rare"), (F.hash("id") % 100).cast("double").alias("v"))
    yield rows
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_segments_carry_over(spark, long):
    cut = segments.segmented(long, "episode_id", ["t"])
    sizes = [r["count"] for r in cut.groupBy("_segment").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1000  # the long episode's 3,600 rows aren't in one task
    rows = sorted(tuple(r) for r in long.collect())
    last, total, held, position = {}, {}, {}, {}
    for e, t, rare, v in rows:
        last[e] = rare if rare is not None else last.get(e)
        total[e] = total.get(e, 0.0) + v
        held[t], position[t] = last[e], total[e]
    assert {r["t"]: r["h"] for r in segments.held(long, "episode_id", ["t"], F.col("rare"), "h").collect()} == held
    assert {r["t"]: r["p"] for r in segments.replayed(long, "episode_id", ["t"], F.col("v"), "p").collect()} == position
    for n in (1, 7, 900):
        mine = {}
        want = {}
        for e, t, _, v in rows:
            mine.setdefault(e, []).append(v)
            want[t] = float(np.mean(mine[e][-n:]))
        got = {r["t"]: r["a"] for r in segments.moving_average(long, "episode_id", ["t"], "v", n, "a").collect()}
        assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want), n


def test_as_of_over_segments(spark, long):
    left = long.where("t % 2 = 0").select("episode_id", "t")
    right = long.where("t % 31 = 0").select("episode_id", "t", "v")
    seen, want = {}, {}
    for e, t, _, v in sorted(tuple(r) for r in long.collect()):
        if t % 31 == 0:
            seen[e] = v
        if t % 2 == 0:
            want[t] = seen.get(e)
    assert {r["t"]: r["latest_v"] for r in segments.as_of(left, right, "episode_id", "t", "v").collect()} == want


def test_listing_and_lengths(spark, tmp_path):
    for name, n in (("a/e2", 2), ("a/e10", 3), ("b/e2", 1)):
        (tmp_path / name).mkdir(parents=True)
        for i in range(n):
            (tmp_path / name / f"f{i}.pkl").write_bytes(b"x")
    (tmp_path / "c").mkdir()
    with containers.Archive(str(tmp_path / "c" / "trajectory.npz"), "w") as f:
        f.create_group("frames").create_dataset("x", data=np.zeros((5, 2)))
    found = fr.listing(spark, str(tmp_path), "*.pkl")
    assert {(r["folder"], r["name"], r["length"]) for r in found.collect()} == {(f"{e}", f"f{i}.pkl", 1) for e, n in (("a/e2", 2), ("a/e10", 3), ("b/e2", 1)) for i in range(n)}
    assert "content" not in str(found._jdf.queryExecution().executedPlan()).split("ReadSchema")[-1]
    assert [tuple(r) for r in fr.episode_lengths(spark, str(tmp_path)).collect()] == [("a/e2", 2), ("a/e10", 3), ("b/e2", 1), ("c", 5)]
    assert [r["name"] for r in fr.trajectory_listing(spark, str(tmp_path), 1).collect()] == ["trajectory.npz"]
