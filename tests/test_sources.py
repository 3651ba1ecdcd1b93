"""Layouts written in memory and read back."""

import json
import os
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.sources import frames as fr
from frameloom.sources import sinks, texts
from tests import fake_h5


def frame(i, **more):
    return {"joint_positions": np.full(7, i, np.float32), "ee_pos_quat": np.array([i, 0, 0, 0, 0, 0], float), "gripper_position": np.array([i > 1], np.float32), "control": np.full(7, i + 10.0), "activated": True, "language_instruction": "pick"} | more


@pytest.fixture()
def folder(tmp_path):
    for e in ("e1", "e2_failed"):
        (tmp_path / e).mkdir()
        for i in (1, 2, 10):
            (tmp_path / e / f"f{i}.pkl").write_bytes(pickle.dumps(frame(i)))
    return tmp_path


def test_pickles(spark, folder):
    (folder / "e1" / "f3.pkl").write_bytes(pickle.dumps(frame(3, activated={"l": False, "r": False})))
    (folder / "e1" / "f4.pkl").write_bytes(b"broken")
    (folder / "e1" / "f5.pkl").write_bytes(pickle.dumps(os.system))
    rows = fr.read_pickles(spark, str(folder)).where("episode_id = 'e1'").orderBy("frame_index").collect()
    assert [r.file for r in rows] == ["f1.pkl", "f2.pkl", "f10.pkl"] and rows[2].control[0] == 20.0 and rows[1].gripper == 1.0
    assert {r.file for r in fr.unreadable(spark, str(folder)).collect()} == {"f4.pkl", "f5.pkl"}
    assert fr.layout_of(str(folder)) == "pickle_folders" and fr.episode_length(str(folder / "e1")) == 6
    assert fr.episode_folders(str(folder)) == ["e1"] and fr.read_episodes(spark, str(folder)).count() == 6


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", robot_state=np.ones((3, 6)), action=np.zeros((3, 7)), timestamps=np.arange(3.0), gripper_state=np.array([0, 0, 1.0]), language_instruction="go")
    rows = fr.read_npz(spark, str(tmp_path)).orderBy("frame_index").collect()
    assert [r.gripper for r in rows] == [0, 0, 1] and rows[0].state == [1.0] * 6 and rows[0].language_instruction == "go"
    assert fr.layout_of(str(tmp_path)) == "npz"


def test_jsonl(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "info.json").write_text("{}")
    with (tmp_path / "ep.jsonl").open("w") as f:
        for i in (1, 0):
            f.write(json.dumps({"timestamp": i, "action": [i], "observation": {"state": [i, 1], "images": {"base_rgb": "x.png"}}}) + "\n")
    rows = fr.read_jsonl(spark, str(tmp_path)).orderBy("frame_index").collect()
    assert [r.action for r in rows] == [[0.0], [1.0]] and rows[0].images.base_rgb == "x.png" and fr.layout_of(str(tmp_path)) == "jsonl"


def test_lerobot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, i, i / 10, [float(i)] * 7, [0.0] * 7) for i in range(4)], "episode_index int, frame_index int, timestamp double, state array<double>, action array<double>")
    info = sinks.write_lerobot(df, str(tmp_path / "d"), "cup", 10)
    assert info["total_frames"] == 4 and fr.layout_of(str(tmp_path / "d")) == "lerobot"
    back = fr.read_episodes(spark, str(tmp_path / "d")).orderBy("position").collect()
    assert [len(r.action) for r in back] == [7] * 4 and {r.task for r in back} == {"cup"}


def trajectory(path, count=5, **series):
    with fake_h5.File(path, "w") as f:
        if count is not None:
            f.attrs["frame_count"] = count
        f.create_dataset("timestamps", data=np.array([f"2024-01-01T00:00:0{i}".encode() for i in range(5)]))
        frames = f.create_group("frames")
        for name, data in series.items():
            frames.create_dataset(name, data=data)


def test_h5_frames(spark, tmp_path):
    """The decoder runs on files of the same interface: lengths, missing series, only what is asked for."""
    for name, count, n in (("a", 5, 4), ("b", None, 5), ("c", 0, 5)):
        (tmp_path / name).mkdir()
        trajectory(str(tmp_path / name / "trajectory.h5"), count, joint_positions=np.arange(5.0).reshape(5, 1), control=np.ones((n, 2)), other=np.zeros(5))
        assert fr.episode_length(str(tmp_path / name), fake_h5.File) == (5 if count is None else count)
    assert fr.layout_of(str(tmp_path)) == "child_h5"
    read = lambda **how: fr.read_h5(spark, str(tmp_path), ("joint_positions", "control", "gripper_position"), opener=fake_h5.File, **how)
    rows = read().orderBy("path", "frame_index").collect()
    assert [(r.path[-15], r.frame_index) for r in rows] == [("a", i) for i in range(4)] + [(x, i) for x in "bc" for i in range(5)]
    assert rows[0].control == [1.0, 1.0] and rows[3].joint_positions == [3.0] and rows[0].gripper_position is None
    assert rows[1].raw_ts == "2024-01-01T00:00:01" and {r.frame_count_attr for r in rows} == {5}
    long = read(shortest=False).where("path like '%/a/%'").orderBy("frame_index").collect()
    assert len(long) == 5 and long[4].control is None and long[4].joint_positions == [4.0]
    with fake_h5.File(str(tmp_path / "a" / "trajectory.h5")) as f:
        fr.decoded_h5(f, ("control",))
        assert set(f["frames"].read) <= {"control"}  # columns are pruned


def test_h5_round_trip_and_trim(spark, tmp_path):
    df = spark.createDataFrame([(e, i, f"t{i}", [float(i), e / 2], [1.0]) for e in (1, 2) for i in range(6)], "episode_id long, frame_index long, ts string, control array<double>, gripper_position array<double>")
    report = sinks.write_h5(df.repartition(3), str(tmp_path), ("control", "gripper_position"), 10.0, fake_h5.File).orderBy("episode_id").collect()
    assert [r.n_frames for r in report] == [6, 6]
    back = fr.read_h5(spark, str(tmp_path), ("control",), opener=fake_h5.File).orderBy("path", "frame_index").collect()
    assert [r.control for r in back[:6]] == [[float(i), 0.5] for i in range(6)] and back[2].raw_ts == "t2"
    again = sinks.write_h5(df, str(tmp_path), ("control", "gripper_position"), 10.0, fake_h5.File).collect()
    assert len(again) == 2 and sorted(os.listdir(tmp_path / "1")) == ["trajectory.h5"]  # replaced whole
    ranges = spark.createDataFrame([(report[0].path, str(tmp_path / "out" / "trajectory.h5"), 2, 5, 6)], "path string, out string, start long, end long, n long")
    assert sinks.rewrite_trimmed(ranges, fake_h5.File).first().frame_count == 3
    with fake_h5.File(str(tmp_path / "out" / "trajectory.h5")) as f:
        assert dict(f.attrs) == {"frame_count": 3, "video_fps": 10.0}
        assert [t.decode() for t in f["timestamps"][:]] == ["t2", "t3", "t4"] and f["frames"]["control"][:, 0].tolist() == [2, 3, 4]


def test_trim_copies_what_has_no_frames():
    source, target = fake_h5.Group(), fake_h5.Group()
    source.create_dataset("camera", data=np.eye(3)).attrs["unit"] = "mm"
    source.create_dataset("one", data=np.float64(7))
    streams = source.create_group("videos")
    streams.create_dataset("base_rgb", data=np.arange(9, dtype=np.uint8)).attrs["codec"] = "x"
    with pytest.raises(ValueError, match="streams"):
        sinks.copy_trimmed(source, fake_h5.Group(), 1, 3, 6)
    sinks.copy_trimmed(source, target, 1, 3, 6, lambda s, a, b: bytes(s[a:b]))
    assert target["camera"].shape == (3, 3) and target["camera"].attrs == {"unit": "mm"} and target["one"][()] == 7
    assert target["videos"]["base_rgb"][:].tolist() == [1, 2] and target["videos"]["base_rgb"].attrs == {"codec": "x"}


def test_h5_needs_its_library(spark, tmp_path):
    (tmp_path / "trajectory.h5").write_bytes(b"")
    assert fr.layout_of(str(tmp_path)) == "root_h5"
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="h5py"):
            fr.read_h5(spark, str(tmp_path))


def test_texts(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "freq.txt").write_text("Average FPS: 9\nMax FPS: 10\n\n0: 9.5\n1: 10\n")
    assert [(r.episode_id, r.step, r.hz) for r in texts.read_freq(spark, str(tmp_path)).orderBy("step").collect()] == [("e", 0, 9.5), ("e", 1, 10.0)]
    (tmp_path / "args_log.txt").write_text("lr: 0.1\nn: 3\nflag: True\nnone: None\nname: a: b\n")
    got = {r.key: (r.value, r.kind) for r in texts.read_args(spark, str(tmp_path / "args_log.txt")).collect()}
    assert got == {"lr": ("0.1", "float"), "n": ("3", "int"), "flag": ("True", "bool"), "none": ("None", "none"), "name": ("a: b", "text")}
    line = "I wE9ryARX: r:" + " ".join(map(str, range(16))) + "|l:1 2&R,A,rightTrig 0.5"
    rows = texts.parse_headset(spark.createDataFrame([(line,), ("noise",)], "value string")).collect()
    assert len(rows) == 1 and rows[0].side == "r" and rows[0].buttons == {"A": [1.0], "rightTrig": [0.5], **{k: [0.0] for k in ("B", "RThU", "RJ", "RG", "RTr")}}
    (tmp_path / "c.yaml").write_text("a: 1\n")
    assert str(texts.load_yaml(str(tmp_path / "c.yaml"))["a"]) == "1"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", 1)], "task_id string, x long")
    sinks.append_frames(df, str(tmp_path / "t"))
    sinks.append_frames(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError):
        sinks.append_frames(df.withColumn("y", F.lit(1)), str(tmp_path / "t"))
    sinks.save_once(df, str(tmp_path / "s"))
    sinks.save_once(df.union(df), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    made = []
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path), {"a": 1}, lambda: made.append(1) or df).count() == 1
    assert len(made) == 1
    sinks.write_json(str(tmp_path / "r" / "x.json"), {"a": np.arange(2), 1: {2.5}})
    assert json.load(open(tmp_path / "r" / "x.json")) == {"a": [0, 1], "1": [2.5]}
    legacy = spark.createDataFrame([(b"a", b"b", 1)], "tactile_rgb binary, tactile_raw_rgb binary, t_marker_tracking int")
    assert sinks.legacy_columns(legacy).collect()[0].asDict() == {"tactile_rgb": b"b"}
    slots = sinks.camera_slots(spark.createDataFrame([(b"a", b"b")], "base_rgb binary, wrist_rgb binary"), "zeros").first()
    assert slots.slot_rgb == b"" and slots.slot_mask is False
    scripts = sinks.deploy_scripts(spark.createDataFrame([("r1", "c9")], "run string, checkpoint string"), "go {run} {checkpoint}")
    assert scripts.first().script == "go r1 c9"
    streams = spark.createDataFrame([("e", "s", b"o", False), ("e", "u", b"o", True)], "episode_id string, stream string, payload binary, replaced boolean")
    new = spark.createDataFrame([("e", "s", b"n"), ("e", "u", b"n")], "episode_id string, stream string, payload binary")
    assert {r.stream: (bytes(r.payload), r.replaced) for r in sinks.replaced_streams(streams, new).collect()} == {"s": (b"n", True), "u": (b"o", True)}


def test_pickles_of_equal_folder_names_and_times(spark, tmp_path):
    for root, base in (("a", 0), ("b", 100)):
        (tmp_path / root / "ep1").mkdir(parents=True)
        times = [5.5, "2024-01-01T00:00:02", None]
        for i, t in enumerate(times):
            (tmp_path / root / "ep1" / f"f{i}.pkl").write_bytes(pickle.dumps(frame(base + i) | ({} if t is None else {"timestamp": t})))
    rows = fr.read_pickles(spark, str(tmp_path)).orderBy("episode_id", "frame_index").collect()
    assert [(r.episode_id, r.frame_index, r.control[0]) for r in rows] == [(f"{e}/ep1", i, b + i + 10.0) for e, b in (("a", 0), ("b", 100)) for i in range(3)]
    assert [r.t for r in rows[:3]] == [5.5, 1704067202.0, 2.0]
    own = fr.read_pickles(spark, f"file://{tmp_path}/a/ep1")
    assert {r.episode_id for r in own.collect()} == {"ep1"}


def test_jsonl_frames_of_equal_times_keep_their_place(spark, tmp_path):
    with (tmp_path / "e.jsonl").open("w") as f:
        for i, t in enumerate([3, 1, 1, None, 1, None]):
            f.write(json.dumps({"timestamp": t, "action": [i]}) + "\n")
    rows = fr.read_jsonl(spark, str(tmp_path)).orderBy("frame_index").collect()
    assert [r.action[0] for r in rows] == [3.0, 5.0, 1.0, 2.0, 4.0, 0.0]


def test_jsonl_files_of_many_episodes(spark, tmp_path):
    """The episode is a field of each line; a missing one is null."""
    for name, lines in {"a": [("e1", 2, 0), ("e2", 1, 1), ("e1", 2, 2)], "b": [("e3", 5, 3), (None, 5, 4)]}.items():
        with (tmp_path / f"{name}.json").open("w") as f:
            for e, t, x in lines:
                f.write(json.dumps(({"who": e} if e else {}) | {"timestamp": t, "action": [x]}) + "\n")
    rows = fr.read_jsonl(spark, str(tmp_path), "*.json", column="who").collect()
    assert sorted(((r.episode_id, r.frame_index, r.action[0]) for r in rows), key=str) == [("e1", 0, 0.0), ("e1", 1, 2.0), ("e2", 0, 1.0), ("e3", 0, 3.0), (None, 0, 4.0)]


def test_jsonl_frames_write_no_folder_an_episode(spark, data, tmp_path, monkeypatch):
    from frameloom.plans import catalog, catalogue_queries

    monkeypatch.setattr(catalogue_queries, "work_folder", lambda spark: str(tmp_path / "j"))
    episodes = catalog.QUERIES["jsonl_frames"](spark, data).select("episode_id").distinct().count()
    assert len(list((tmp_path / "j").rglob("*.json"))) < episodes


def test_nodes_keep_signs_and_the_last_of_equal_keys(spark):
    lines = spark.createDataFrame([("n1", "State=IDLE  CfgTRES=cpu=4,gres/gpu=2 Flag State=DOWN")], "name string, value string")
    row = texts.parse_nodes(lines).first()
    assert row["name"] == "n1" and row["fields"] == {"State": "DOWN", "CfgTRES": "cpu=4,gres/gpu=2", "Flag": None}


def test_projection_of_image_pairs(spark):
    from frameloom.functions import images

    rng = np.random.default_rng(2)
    pixels = [rng.integers(0, 255, (8, 6, 3), dtype=np.uint8) for _ in range(4)]
    rows = [(i, pixels[i].tobytes(), None if i == 3 else pixels[i - 1].tobytes()) for i in range(4)]
    df = spark.createDataFrame(rows, "i int, l binary, r binary").repartition(3)
    got = {r["i"]: np.array(r["tactile_embedding"]) for r in images.project_pairs(df, "l", "r", (8, 6, 3), 16).collect()}
    for i, (_, a, b) in enumerate(rows):
        want = images.Projection(16)(pixels[i], None if b is None else pixels[i - 1])
        assert np.allclose(got[i], want, atol=1e-6)
        norms = np.linalg.norm(got[i].reshape(2, -1), axis=1)
        assert abs(norms[0] - 1) < 1e-5 and (abs(norms[1] - 1) < 1e-5 or norms[1] == 0)


def test_newest_force_is_sent_each_batch(spark, tmp_path):
    import socket

    spark.createDataFrame([(1, 0.5, 0.25), (2, 0.12345, 1.0)], "ts int, l double, r double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts int, l double, r double").parquet(str(tmp_path / "in"))
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as listener:
        listener.bind(("127.0.0.1", 0))
        listener.settimeout(30)
        query = sinks.send_packets(stream, "127.0.0.1", listener.getsockname()[1], "l", "r").option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        text = listener.recv(1000).decode()
    assert "0.1234" in text or "0.1235" in text
    assert "1.0000" in text
