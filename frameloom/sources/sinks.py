"""Sinks: frame tables, datasets with metadata, reports, statistics, packets."""

from __future__ import annotations

import contextlib
import json
import os
import socket
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.signals import packet

from .frames import need_h5


def append_frames(frames: DataFrame, path: str, by: str = "task_id") -> None:
    """Appends to a frame table; a table that exists fixes names and types."""
    try:
        held = frames.sparkSession.read.parquet(path).schema
    except AnalysisException:
        held = None
    if held is not None:
        want = {f.name: f.dataType for f in held if f.name != by}
        got = {f.name: f.dataType for f in frames.schema if f.name != by}
        if want != got:
            raise ValueError(f"the table has {want}, the rows have {got}")
    frames.write.mode("append").partitionBy(by).parquet(path)


def write_lerobot(frames: DataFrame, root: str, task: str, fps: int) -> dict:
    """Frames (episode_index, frame_index, timestamp, observation.state, action, task) as Parquet with meta/info.json. root is a
    local or mounted folder. Returns the report."""
    frames.withColumn("task", F.lit(task)).repartition("episode_index").sortWithinPartitions("episode_index", "frame_index").write.mode("error").parquet(f"{root}/data")
    totals = frames.agg(F.count_distinct("episode_index").alias("episodes"), F.count(F.lit(1)).alias("frames")).first()
    info = {"codebase_version": "v2.0", "fps": fps, "total_episodes": totals["episodes"], "total_frames": totals["frames"], "features": {f.name: f.dataType.simpleString() for f in frames.schema}}
    write_json(f"{root}/meta/info.json", info)
    return info


def write_json(path: str, data) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(jsonable(data), f, indent=2, ensure_ascii=False)


def jsonable(x):
    """Arrays, scalars, paths and nested containers as plain JSON values."""
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [jsonable(v) for v in x]
    if hasattr(x, "tolist"):
        return x.tolist()
    return x if x is None or isinstance(x, (str, int, float, bool)) else str(x)


def save_once(stats: DataFrame, path: str) -> None:
    """Statistics are written once and never overwritten."""
    stats.write.mode("ignore").parquet(path)


def cached(spark: SparkSession, root: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A table keyed by its configuration: made once, read afterwards."""
    import hashlib

    path = f"{root}/{hashlib.md5(json.dumps(jsonable(config), sort_keys=True).encode()).hexdigest()[:12]}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("ignore").parquet(path)
        return spark.read.parquet(path)


@contextlib.contextmanager
def _placed(path: str) -> Iterator[str]:
    """A name beside path to write to; what is written there takes its place once it is whole."""
    beside = f"{path}.{uuid.uuid4().hex}"
    try:
        yield beside
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.remove(beside)


def write_h5(frames: DataFrame, root: str, columns: tuple[str, ...], fps: float = 15.0, opener=None) -> DataFrame:
    """One trajectory file an episode below root, a folder that all executors have: times, frames/<column>, and the
    attributes frame_count and video_fps. frames: episode_id, frame_index, ts (text) and the columns, vectors of one
    width within an episode. An episode is one file, so it is written by one task, beside its place first and then moved
    there: a task that runs again replaces the file whole. Returns episode_id, path, n_frames; the files are written when
    that is read. opener: in place of h5py.File."""

    def write(g: pd.DataFrame) -> pd.DataFrame:
        open_file = opener or need_h5().File
        g = g.sort_values("frame_index")
        episode = g["episode_id"].iat[0]
        folder = os.path.join(root, str(episode))
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, "trajectory.h5")
        with _placed(path) as beside, open_file(beside, "w") as f:
            f.attrs["frame_count"], f.attrs["video_fps"] = len(g), fps
            f.create_dataset("timestamps", data=np.array([str(t).encode() for t in g["ts"]]))
            series = f.create_group("frames")
            for c in columns:
                series.create_dataset(c, data=np.stack([np.asarray(v, float) for v in g[c]]))
        return pd.DataFrame({"episode_id": [episode], "path": [path], "n_frames": [len(g)]})

    kind = dict(frames.dtypes)["episode_id"]
    return frames.select("episode_id", "frame_index", "ts", *columns).groupBy("episode_id").applyInPandas(write, f"episode_id {kind}, path string, n_frames bigint")


def copy_trimmed(source, target, start: int, end: int, frames: int, video=None) -> None:
    """A group of a trajectory file with the frames [start, end) alone: attributes are copied, and so are data sets,
    of which those with one entry a frame are cut. Encoded streams (the group videos) need ``video``, a function from
    (data set, start, end) to the bytes of the cut stream."""
    for k, v in source.attrs.items():
        target.attrs[k] = v
    for name in source.keys():
        item = source[name]
        if hasattr(item, "keys"):
            inner = target.create_group(name)
            if name == "videos":
                if len(item) and video is None:
                    raise ValueError("encoded streams can't be cut without a function that does it")
                for k, v in item.attrs.items():
                    inner.attrs[k] = v
                for stream in item.keys():
                    made = inner.create_dataset(stream, data=np.frombuffer(video(item[stream], start, end), np.uint8))
                    for k, v in item[stream].attrs.items():
                        made.attrs[k] = v
            else:
                copy_trimmed(item, inner, start, end, frames, video)
            continue
        whole = item.shape and item.shape[0] == frames
        made = target.create_dataset(name, data=item[start:end] if whole else item[()])
        for k, v in item.attrs.items():
            made.attrs[k] = v


def rewrite_trimmed(ranges: DataFrame, opener=None, video=None) -> DataFrame:
    """Trajectory files cut to their ranges, one task a file. ranges: path, out, start, end, n. Returns path, out and
    frame_count; the files are written when that is read."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_file = opener or need_h5().File
        for batch in batches:
            for r in batch.itertuples():
                os.makedirs(os.path.dirname(r.out) or ".", exist_ok=True)
                with _placed(r.out) as beside, open_file(r.path, "r") as source, open_file(beside, "w") as target:
                    copy_trimmed(source, target, r.start, r.end, r.n, video)
                    target.attrs["frame_count"] = r.end - r.start
            yield batch[["path", "out"]].assign(frame_count=batch["end"] - batch["start"])

    return ranges.select("path", "out", "start", "end", "n").repartition("path").mapInPandas(rewrite, "path string, out string, frame_count bigint")


# Endings of legacy fields that are left out.
LEGACY_DROPPED = ("_marker_tracking", "_raw_rgb")


def legacy_columns(frames: DataFrame) -> DataFrame:
    """Legacy frames without tracking and raw images; the processed image is taken from the raw one where it exists."""
    raws = {c: c.replace("_raw_rgb", "_rgb") for c in frames.columns if c.endswith("_raw_rgb")}
    for raw, plain in raws.items():
        frames = frames.withColumn(plain, F.coalesce(F.col(raw), F.col(plain)) if plain in frames.columns else F.col(raw))
    return frames.drop(*[c for c in frames.columns if c.endswith(LEGACY_DROPPED)])


def renamed(frames: DataFrame, names: dict[str, str]) -> DataFrame:
    return frames.withColumnsRenamed(names)


def camera_slots(frames: DataFrame, strategy: str, base: str = "base_rgb", wrist: str = "wrist_rgb") -> DataFrame:
    """A third camera slot with its mask: zeros (masked out), or a copy of the base or wrist image."""
    fill = {"zeros": F.lit(b""), "duplicate_base": F.col(base), "duplicate_wrist": F.col(wrist)}[strategy]
    return frames.withColumn("slot_rgb", fill).withColumn("slot_mask", F.lit(strategy != "zeros"))


def replaced_streams(streams: DataFrame, made: DataFrame) -> DataFrame:
    """Streams with replacements (episode_id, stream, payload) put in once: replaced ones are marked and never redone."""
    new = made.select("episode_id", "stream", F.col("payload").alias("_new"))
    joined = streams.join(new, ["episode_id", "stream"], "left")
    fresh = F.col("_new").isNotNull() & ~F.coalesce("replaced", F.lit(False))
    return joined.withColumn("payload", F.when(fresh, F.col("_new")).otherwise(F.col("payload"))).withColumn("replaced", F.coalesce("replaced", F.lit(False)) | fresh).drop("_new")


def send_packets(stream: DataFrame, host: str, port: int, left: str, right: str):
    """A streaming query that sends each batch's newest force as a UDP packet (a batch is a tick)."""

    def send(batch: DataFrame, number: int) -> None:
        row = batch.orderBy(F.desc("ts")).select(packet(F.col(left), F.col(right)).alias("p")).limit(1).collect()
        if row:
            with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
                s.sendto(row[0]["p"].encode(), (host, port))

    return stream.writeStream.foreachBatch(send)


def deploy_scripts(runs: DataFrame, template: str) -> DataFrame:
    """One script for each run, from a template with {run} and {checkpoint}."""
    text = F.lit(template)
    for name in ("run", "checkpoint"):
        text = F.replace(text, F.lit("{" + name + "}"), F.col(name))
    return runs.withColumn("script", text)
