"""Frame layouts: pickles, npz, JSONL, LeRobot Parquet, HDF5, and which of them a folder holds."""

from __future__ import annotations

import io
import json
import os
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions.text import EXCLUDED_ENDINGS, natural_key

# What an array pickle may name; everything else is refused.
ALLOWED = {
    ("numpy", "ndarray"), ("numpy", "dtype"), ("numpy", "float32"), ("numpy", "float64"),
    ("numpy.core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"),
    ("numpy._core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "scalar"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer"),
}


class ArraysOnly(pickle.Unpickler):
    """Reads plain values and NumPy arrays; a pickle that names anything else is an error, not code to run."""

    def find_class(self, module: str, name: str):
        if (module, name) not in ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} isn't allowed")
        return super().find_class(module, name)


def safe_pickle(data: bytes):
    return ArraysOnly(io.BytesIO(data)).load()


FRAME = "path string, episode_id string, file string, t double, activated boolean, joint_positions array<double>, ee_pose array<double>, gripper double, control array<double>, touch array<double>, language_instruction string, error string"


def _vector(x) -> list[float] | None:
    return None if x is None else np.asarray(x, float).reshape(-1).tolist()


def _seconds(x) -> float | None:
    """A frame's time in seconds: a number, or a date and time as text (UTC where it has no zone); null if it is neither."""
    try:
        return float(np.asarray(x.decode() if isinstance(x, bytes) else x, float).reshape(-1)[0])
    except (TypeError, ValueError, IndexError):
        pass
    try:
        t = pd.Timestamp(x.decode() if isinstance(x, bytes) else x)
        return None if t is pd.NaT else (t.tz_localize("UTC") if t.tz is None else t).timestamp()
    except (TypeError, ValueError):
        return None


def _frame_row(path: str, data: bytes) -> tuple:
    head = (path, *path.rsplit("/", 2)[1:])
    try:
        f = safe_pickle(data)
        active = f.get("activated", True)
        active = bool(active.get("l") or active.get("r")) if isinstance(active, dict) else bool(active)
        grip = f.get("gripper_position")
        return (*head, _seconds(f.get("timestamp")), active, _vector(f.get("joint_positions")), _vector(f.get("ee_pos_quat")), None if grip is None else float(np.asarray(grip).reshape(-1)[0]), _vector(f.get("control")), _vector(f.get("touch")), f.get("language_instruction"), None)
    except Exception as e:  # an unreadable file is a row, not an abort
        return (*head, *[None] * 8, type(e).__name__)


def read_pickles(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    """One row for each frame file below a path, in natural order within its folder (frame_index). An episode is a folder,
    named by its path below ``path`` (its own name if it is that folder). t is the frame's timestamp, else its
    frame_index. A boolean ``activated`` counts for both hands. Unreadable files are left out; unreadable() lists them."""
    rows = _pickles(spark, path).where("error is null")
    order = Window.partitionBy("episode_id").orderBy(natural_key(F.col("file")))
    if active_only:
        rows = rows.where("activated")
    rows = rows.withColumn("frame_index", (F.row_number().over(order) - 1).cast("bigint"))
    return rows.withColumn("t", F.coalesce("t", F.col("frame_index").cast("double"))).drop("error")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    return _pickles(spark, path).where("error is not null").select("path", "episode_id", "file", "error")


def _below(folder: Column, root: str) -> Column:
    """A folder's path below a root, whatever scheme either is written with; the root's own name for the root itself."""
    plain = root.split("://", 1)[-1] if "://" in root else root.removeprefix("file:")
    plain = "/" + plain.strip("/")
    inside = F.substring_index(folder, plain + "/", -1) if plain != "/" else F.ltrim(folder, F.lit("/"))
    return F.when(folder.endswith(plain), F.lit(plain.rsplit("/", 1)[-1])).otherwise(inside)


def _pickles(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pkl").load(path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FRAME.split(", ")]
        for batch in batches:
            yield pd.DataFrame([_frame_row(p, d) for p, d in zip(batch["path"], batch["content"])], columns=names)

    rows = files.select("path", "content").mapInPandas(decode, FRAME)
    return rows.withColumn("episode_id", _below(F.regexp_extract("path", "^(.*)/[^/]*$", 1), path))


def listing(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """Files below a path, as Spark's own file index finds them on any of its stores: path, folder (below the path), name,
    length, modified. Contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", files).load(path)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return rows.select("path", _below(folder, path).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def trajectory_listing(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Trajectory files below a path in order of their paths, the first ``limit`` of them."""
    found = listing(spark, path, "*.{h5,npz}").where((F.col("name").endswith(".h5")) | (F.col("name") == "trajectory.npz")).orderBy("path")
    return found.limit(limit) if limit is not None else found


def episode_lengths(spark: SparkSession, path: str, opener: str | None = None) -> DataFrame:
    """Episodes below a path in natural order of their names, with n_frames, without decoding any: trajectory files by
    their attribute, times or first series, opened where the tasks run; folders of pickles by counting. opener:
    module:name, as for the trajectory source."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .trajectories import opened

        for batch in batches:
            n = []
            for p in batch["path"]:
                with opened(p, opener) as f:
                    n.append(frames_in(f))
            yield batch[["episode_id"]].assign(n_frames=n)

    files = listing(spark, path, "*.{h5,npz,pkl}")
    own = F.concat_ws("/", F.when(F.col("folder") != F.lit(path.rstrip("/").rsplit("/", 1)[-1]), F.col("folder")), F.regexp_replace("name", r"\.h5$", ""))
    held = files.where((F.col("name").endswith(".h5")) | (F.col("name") == "trajectory.npz"))
    named = held.select("path", F.when(F.col("name").isin("trajectory.h5", "trajectory.npz"), F.col("folder")).otherwise(own).alias("episode_id"))
    one = named.mapInPandas(count, "episode_id string, n_frames bigint")
    other = files.where(F.col("name").endswith(".pkl")).groupBy(F.col("folder").alias("episode_id")).agg(F.count(F.lit(1)).alias("n_frames"))
    found = one.unionByName(other.join(one.select("episode_id"), "episode_id", "left_anti"))
    return found.orderBy(natural_key(F.col("episode_id")), "episode_id")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """Episodes in npz files, one row a frame; object arrays are refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path)
    schema = "episode_id string, frame_index bigint, t double, state array<double>, action array<double>, gripper double, language_instruction string"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    state = np.asarray(z["robot_state"], float)
                    n = len(state)
                    pick = lambda k, d: np.asarray(z[k], float) if k in z else d  # noqa: B023, E731
                    action, times, grip = pick("action", np.full((n, 0), np.nan)), pick("timestamps", np.arange(n)), pick("gripper_state", np.full(n, np.nan))
                    prompt = str(z["language_instruction"]) if "language_instruction" in z else None
                    yield pd.DataFrame({"episode_id": p.rsplit("/", 1)[-1][:-4], "frame_index": np.arange(n), "t": times, "state": list(state), "action": list(action), "gripper": grip.reshape(-1), "language_instruction": prompt})

    return files.select("path", "content").mapInPandas(decode, schema)


JSONL = "timestamp double, action array<double>, language_instruction string, observation struct<state: array<double>, images: struct<base_rgb: string, wrist_rgb: string, tactile_left_rgb: string, tactile_right_rgb: string>>"


def read_jsonl(spark: SparkSession, path: str, files: str = "*.jsonl", episode: str = r"([^/]+)\.jsonl$", column: str | None = None) -> DataFrame:
    """Episodes in JSONL files, one a file; frames by their timestamp, equal and missing times by their place in the file.
    episode: the pattern that finds an episode's name in its file's path. column: the field of each line that names its
    episode instead, where a file holds many episodes (null where it is missing)."""
    schema = f"{JSONL}, `{column}` string" if column else JSONL
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", files).json(path)
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    name = F.col(f"`{column}`") if column else F.regexp_extract(F.col("_metadata.file_path"), episode, 1)
    out = rows.select(name.alias("episode_id"), at.alias("_at"), "timestamp", "action", "language_instruction", F.col("observation.state").alias("state"), F.col("observation.images").alias("images"))
    order = Window.partitionBy("episode_id").orderBy("timestamp", "_at")
    return out.withColumn("frame_index", (F.row_number().over(order) - 1).cast("bigint")).drop("_at")


def read_lerobot(spark: SparkSession, path: str) -> DataFrame:
    """Parquet frames of a dataset with meta/info.json, numbered within their episode."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/data")
    return rows.withColumn("position", (F.row_number().over(Window.partitionBy("episode_index").orderBy("frame_index")) - 1).cast("bigint"))


def need_h5():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs the h5py library") from e
    return h5py


def decoded_h5(f, columns: tuple[str, ...], shortest: bool = True) -> dict:
    """Columns of one trajectory file that is open: anything with the file, group and dataset interface of h5py.

    The number of frames is the attribute frame_count, or where that is absent or not positive the length of the first
    series, or of the times. With ``shortest`` it is cut to the shortest of the asked-for series and the times; else
    series that end earlier are null from there on. Only the asked-for series are read."""
    series = f["frames"] if "frames" in f else {}
    times = [t.decode() if isinstance(t, bytes) else str(t) for t in f["timestamps"][:]] if "timestamps" in f else None
    found = {c: np.asarray(series[c][:], float) for c in columns if c in series}
    count = int(f.attrs.get("frame_count", 0))
    if count <= 0:
        count = len(series[next(iter(series.keys()))]) if len(series) else len(times or ())
    n = min([count, *map(len, found.values()), *([len(times)] if times is not None else [])]) if shortest else count
    padded = lambda x: list(x[:n]) + [None] * (n - len(x[:n]))
    out = {"frame_index": np.arange(n), "frame_count_attr": count, "raw_ts": padded(times or [])}
    return out | {c: padded([x.reshape(-1).tolist() for x in found.get(c, ())]) for c in columns}


def read_h5(spark: SparkSession, path: str, columns: tuple[str, ...] = ("joint_positions", "ee_pos_quat", "gripper_position", "control"), shortest: bool = True, opener=None) -> DataFrame:
    """Frames of trajectory files, one task a file; only the asked-for fields are read. With ``shortest`` all series are
    cut to the shortest. Needs h5py on the executors and files they can open, or an ``opener`` of the same interface."""
    if opener is None:
        need_h5()
    files = spark.createDataFrame([(p,) for p in h5_files(path)], "path string").repartition("path")
    schema = "path string, frame_index bigint, frame_count_attr bigint, raw_ts string, " + ", ".join(f"{c} array<double>" for c in columns)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_file = opener or need_h5().File
        for batch in batches:
            for p in batch["path"]:
                with open_file(p, "r") as f:
                    yield pd.DataFrame({"path": p} | decoded_h5(f, columns, shortest))

    return files.mapInPandas(decode, schema)


def h5_files(path: str, recursive: bool = True, limit: int | None = None) -> list[str]:
    if os.path.isfile(path):
        return [path]
    found = [os.path.join(d, f) for d, _, files in os.walk(path) for f in files if f == "trajectory.h5" or f.endswith(".h5")] if recursive else [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".h5")]
    return sorted(found)[:limit]


def natural(name: str) -> list:
    return [int(t) if t.isdigit() else t for t in re.findall(r"\d+|\D+", name.lower())]


def layout_of(path: str) -> str:
    """The layout of a local folder, first that fits: lerobot, jsonl, h5 or npz file, root h5, child h5, deep h5, pickle folders, npz, pickles."""
    inside = lambda *p: os.path.join(path, *p)
    if os.path.isfile(path):
        return "h5_file" if path.endswith(".h5") else "npz_file" if path.endswith(".npz") else "file"
    names = sorted(os.listdir(path), key=natural)
    if os.path.exists(inside("meta", "info.json")):
        info = json.load(open(inside("meta", "info.json"), encoding="utf-8"))
        return "jsonl" if info.get("format") == "jsonl" or not os.path.isdir(inside("data")) else "lerobot"
    folders = [n for n in names if os.path.isdir(inside(n))]
    if os.path.exists(inside("trajectory.h5")):
        return "root_h5"
    if any(os.path.exists(inside(f, "trajectory.h5")) for f in folders):
        return "child_h5"
    if h5_files(path):
        return "deep_h5"
    if any(n.endswith(".pkl") for f in folders for n in os.listdir(inside(f))):
        return "pickle_folders"
    if any(n.endswith(".npz") for n in names):
        return "npz"
    return "pickles" if any(n.endswith(".pkl") for n in names) else "unknown"


READERS = {"lerobot": read_lerobot, "jsonl": read_jsonl, "root_h5": read_h5, "child_h5": read_h5, "deep_h5": read_h5, "h5_file": read_h5, "pickle_folders": read_pickles, "pickles": read_pickles, "npz": read_npz}


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a folder in whatever layout it has."""
    layout = layout_of(path)
    if layout not in READERS:
        raise ValueError(f"no known layout in {path}")
    return READERS[layout](spark, path)


def frames_in(f) -> int:
    """Frames of an open trajectory file: the attribute, the times, or the first series."""
    if "frame_count" in f.attrs:
        return int(f.attrs["frame_count"])
    if "timestamps" in f:
        return len(f["timestamps"])
    return len(next(iter(f["frames"].values()))) if "frames" in f and len(f["frames"]) else 0


def episode_length(path: str, opener=None) -> int:
    """Frames of one local episode without decoding it; episode_lengths() does that for all below a path."""
    h5 = os.path.join(path, "trajectory.h5") if os.path.isdir(path) else path
    if h5.endswith(".h5") and os.path.exists(h5):
        with (opener or need_h5().File)(h5, "r") as f:
            return frames_in(f)
    return sum(n.endswith(".pkl") for n in os.listdir(path))


def episode_folders(path: str, prefix: str | None = None, endings: tuple[str, ...] = EXCLUDED_ENDINGS) -> list[str]:
    """Folders of a local root in natural order, by wanted prefixes, without excluded endings."""
    names = sorted((n for n in os.listdir(path) if os.path.isdir(os.path.join(path, n))), key=natural)
    wanted = prefix.split("-") if prefix else [""]
    return [n for n in names if any(n.startswith(p) for p in wanted) and not n.endswith(endings)]
