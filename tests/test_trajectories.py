"""The trajectory data source: what is read and opened, both phases of writing, and replay by steps across a restart."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.sources import containers, frames, trajectories

#: Data sets that a reader decoded, by the archive's path: lines of this file below the root.
LOG = "decoded.log"


class Watched(containers.Archive):
    """An archive that notes which of its data sets are read."""

    def __init__(self, path, mode="r"):
        super().__init__(path, mode)
        self.log = os.path.join(os.path.dirname(os.path.dirname(str(path))), LOG)
        if mode == "r":
            self.note("opened")

    def note(self, what):
        with open(self.log, "a") as f:
            f.write(f"{os.path.basename(os.path.dirname(self.zip.filename))} {what}\n")

    def __exit__(self, *error):
        if self.mode == "r":
            for name in self.decoded:
                self.note(name)
        super().__exit__(*error)


def two_halves(data, attrs):
    """A stand-in for a video decoder: half of the bytes a frame."""
    n = int(attrs["frames"])
    return [data[i * len(data) // n : (i + 1) * len(data) // n] for i in range(n)]


OPENER = "tests.test_trajectories:Watched"


def make(root, name, n, **series):
    os.makedirs(root / name)
    with containers.Archive(str(root / name / "trajectory.npz"), "w") as f:
        f.attrs["frame_count"] = n
        f.create_dataset("timestamps", data=np.array([f"t{i}".encode() for i in range(n)]))
        group = f.create_group("frames")
        for k, v in series.items():
            group.create_dataset(k, data=v)
        video = f.create_group("videos").create_dataset("base_camera_rgb", data=np.arange(2 * n, dtype=np.uint8))
        video.attrs["frames"] = n


@pytest.fixture
def root(tmp_path):
    for k, name in enumerate(("a1", "a2", "b1")):
        make(tmp_path, name, 6, joint_positions=np.arange(12.0).reshape(6, 2) + k, ee_pos=np.ones((6, 3)), short=np.zeros(5))
    return tmp_path


def log_of(root):
    return (root / LOG).read_text().split("\n")[:-1] if (root / LOG).exists() else []


def test_reads_asked_fields_by_alias(spark, root):
    trajectories.register(spark)
    schema = "episode_id string, frame_index bigint, state array<double>, base_rgb binary"
    df = spark.read.format("trajectories").schema(schema).option("opener", OPENER).option("decoder", "tests.test_trajectories:two_halves").option("aliases", '{"state": ["joint_positions"], "base_rgb": ["base_camera_rgb"]}').load(str(root))
    only = df.where("episode_id = 'a2' and frame_index >= 2 and frame_index < 4")
    assert "PushedFilters" in only._jdf.queryExecution().toString() or "filters" in only._jdf.queryExecution().toString().lower()
    rows = only.orderBy("frame_index").collect()
    assert [tuple(r) for r in rows] == [("a2", 2, [5.0, 6.0], bytes([4, 5])), ("a2", 3, [7.0, 8.0], bytes([6, 7]))]
    assert set(log_of(root)) == {"a2 opened", "a2 frames/joint_positions", "a2 videos/base_camera_rgb"}
    assert df.where("episode_id like 'a%'").count() == 10  # cut to the shortest of all series, asked for or not
    assert not any(line.startswith("b1") for line in log_of(root))
    assert df.where("episode_id = 'none'").count() == 0


def test_default_schema_and_padding(spark, root):
    trajectories.register(spark)
    df = spark.read.format("trajectories").options(columns="short,missing", shortest="false", opener=OPENER).load(str(root))
    assert df.columns == ["path", "episode_id", "frame_index", "frame_count", "raw_ts", "short", "missing"]
    rows = df.where("episode_id = 'b1'").orderBy("frame_index").collect()
    assert len(rows) == 6 and rows[5]["short"] is None and rows[5]["raw_ts"] == "t5" and rows[0]["short"] == [0.0] and rows[0]["missing"] is None
    one = spark.read.format("trajectories").options(columns="ee_pos").load(str(root / "a1" / "trajectory.npz")).first()
    assert one["episode_id"] == "a1" and one["ee_pos"] == [1.0] * 3
    with pytest.raises(Exception, match="decoder"):
        spark.read.format("trajectories").schema("base_camera_rgb binary").load(str(root)).collect()
    os.makedirs(root / "none")
    assert spark.read.format("trajectories").options(columns="x").load(str(root / "none")).count() == 0


def frames_of(spark, episodes=("x", "y"), width=2, n=2500):
    return spark.range(n).select(F.explode(F.array(*[F.lit(e) for e in episodes])).alias("episode_id"), F.col("id").alias("frame_index"), F.col("id").cast("string").alias("raw_ts"), F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (F.col("id") + i).cast("double")).alias("state"), F.col("id").cast("double").alias("grip"))


def test_two_phase_writing(spark, tmp_path):
    root = str(tmp_path / "out")
    trajectories.write_trajectories(frames_of(spark).repartition(5), root, container="npz")
    read = lambda: spark.read.format("trajectories").options(columns="state,grip").load(root)
    rows = read().where("episode_id = 'x'").orderBy("frame_index").collect()
    assert len(rows) == 2500 and rows[2499]["state"] == [2500.0, 2501.0] and rows[7]["grip"] == [7.0] and rows[7]["raw_ts"] == "7" and rows[0]["frame_count"] == 2500
    assert sorted(os.listdir(root)) == ["x", "y"]
    # An append with another width, other fields or an episode that is there leaves nothing behind.
    for wrong in (frames_of(spark, ("z",), 3), frames_of(spark, ("z",)).drop("grip"), frames_of(spark, ("z", "y"))):
        with pytest.raises(Exception):
            trajectories.write_trajectories(wrong, root, container="npz")
        assert sorted(os.listdir(root)) == ["x", "y"]
    trajectories.write_trajectories(frames_of(spark, ("z",)), root, container="npz")
    assert read().select("episode_id").distinct().count() == 3
    trajectories.write_trajectories(frames_of(spark, ("y", "w"), n=3), root, "overwrite", container="npz")
    assert {(r[0], r[1]) for r in read().groupBy("episode_id").count().collect()} == {("y", 3), ("w", 3)}


def test_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    bad = frames_of(spark, ("x", "y")).withColumn("grip", F.when((F.col("episode_id") == "y") & (F.col("frame_index") == 2000), F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("grip")))
    with pytest.raises(Exception, match="broken row"):
        trajectories.write_trajectories(bad, root, container="npz")
    assert not os.path.exists(root) or os.listdir(root) == []


def test_trimmed_files(spark, root, tmp_path):
    out = str(tmp_path / "cut")
    ranges = spark.createDataFrame([(str(root / e / "trajectory.npz"), f"{e}/trajectory.npz", 1, 3, 6) for e in ("a1", "b1")], "path string, name string, start bigint, end bigint, n bigint")
    with pytest.raises(Exception, match="encoded streams"):
        trajectories.write_trimmed(ranges, out)
    assert not os.path.exists(out) or os.listdir(out) == []
    trajectories.write_trimmed(ranges, out, video="tests.test_trajectories:cut")
    rows = spark.read.format("trajectories").options(columns="joint_positions").load(out).where("episode_id = 'b1'").orderBy("frame_index").collect()
    assert [r["joint_positions"] for r in rows] == [[4.0, 5.0], [6.0, 7.0]] and rows[0]["raw_ts"] == "t1" and rows[0]["frame_count"] == 2
    assert frames.episode_length(os.path.join(out, "b1"), containers.Archive) == 0  # not HDF5


def cut(stream, start, end):
    return bytes(stream[:])[2 * start : 2 * end]


def test_replay_goes_on_after_a_restart(spark, tmp_path):
    frames_of(spark, n=40).drop("state").repartitionByRange(3, "frame_index").sortWithinPartitions("frame_index").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    seen = []

    def keep(batch, number):
        seen.append((number, sorted({r[0] for r in batch.select("frame_index").collect()}), batch.count()))

    def start():
        stream = trajectories.replay_steps(spark, str(tmp_path / "in"), schema, 9)
        return stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).start()

    query = start()
    until = time.time() + 60
    while len(seen) < 2 and time.time() < until:
        time.sleep(0.05)
    query.stop()
    assert len(seen) >= 2
    query = start()
    query.processAllAvailable()
    query.stop()
    frames_by_batch = {n: (f, c) for n, f, c in seen}  # a batch cut off by the stop comes again, the same
    assert [frames_by_batch[n] for n in sorted(frames_by_batch)] == [(list(range(a, min(a + 9, 40))), 2 * (min(a + 9, 40) - a)) for a in range(0, 40, 9)]
