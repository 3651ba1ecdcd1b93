"""Trajectory files as a Spark data source, and recorded frames as a stream of steps.

``spark.read.format("trajectories")``: one input partition a file. Only the fields of the schema are read, by their
aliases, and of these only the frames that are asked for; filters on episode_id, path and frame_index are pushed down, so
that files and frames they rule out aren't opened.

``df.write.format("trajectories")``: tasks write whole episodes below a staging folder; the driver puts them in place
once every task has succeeded, and removes the staging folder otherwise.

``spark.readStream.format("frame_replay")``: offsets are frame numbers (or another column of steps), a trigger takes the next steps, and the stream ends
with the recording.

A file called trajectory.npz is an archive of containers.py; any other is HDF5, which needs h5py where the tasks run, or an
``opener`` (module:name) of the same interface. Files are reached through
pyarrow's file systems; stores without a local path are opened as file objects.
"""

from __future__ import annotations

import importlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, StructType

#: Columns that every trajectory has beside its fields.
HEAD = "path string, episode_id string, frame_index bigint, frame_count bigint, raw_ts string"
#: Frames of one Arrow batch.
BATCH = 1024
FILES = {"h5": "trajectory.h5", "npz": "trajectory.npz"}


def named(what: str):
    """The object that ``module:name`` names."""
    module, name = what.split(":")
    return getattr(importlib.import_module(module), name)


def store_of(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def open_file(path: str, opener: str | None):
    """What opens files of this name."""
    return named(opener or ("frameloom.sources.containers:Archive" if path.endswith(".npz") else "h5py:File"))


def opened(path: str, opener: str | None):
    """A trajectory file, open for reading."""
    from pyarrow import fs

    store, place = store_of(path)
    return open_file(path, opener)(place if isinstance(store, fs.LocalFileSystem) else store.open_input_file(place), "r")


def trajectory_files(root: str) -> list[str]:
    """Trajectory files below a root, or the root itself, by path."""
    from pyarrow import fs

    store, place = store_of(root)
    if store.get_file_info(place).type == fs.FileType.File:
        return [place]
    found = store.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and (f.path.endswith(".h5") or f.base_name == FILES["npz"]) and "/_staging-" not in f.path)


def episode_of(path: str, root: str) -> str:
    """An episode's name: its folder's path below the root, or of a file with a name of its own its path without the ending."""
    _, place = store_of(root)
    folder, file = os.path.split(os.path.relpath(path, os.path.dirname(place) if path == place else place))
    if file not in FILES.values():
        return os.path.join(folder, file.removesuffix(".h5"))
    return folder or os.path.basename(os.path.dirname(path))


@dataclass
class Wanted:
    """What filters leave: episode names or paths (null: all), their beginnings, and frames from lo to before hi."""

    episodes: set | None = None
    paths: set | None = None
    begins: list[str] = field(default_factory=list)
    lo: int = 0
    hi: int | None = None

    def takes(self, f: Filter) -> bool:
        """Whether this filter is held from now on."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column in ("episode_id", "path") and isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            name = "episodes" if column == "episode_id" else "paths"
            held = getattr(self, name)
            setattr(self, name, values if held is None else held & values)
        elif column == "episode_id" and isinstance(f, StringStartsWith):
            self.begins.append(f.value)
        elif column == "frame_index" and isinstance(f, EqualTo):
            self.lo, self.hi = max(self.lo, f.value), min(f.value + 1, self.hi if self.hi is not None else f.value + 1)
        elif column == "frame_index" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
        elif column == "frame_index" and isinstance(f, (LessThan, LessThanOrEqual)):
            end = f.value + isinstance(f, LessThanOrEqual)
            self.hi = end if self.hi is None else min(self.hi, end)
        else:
            return False
        return True

    def has(self, path: str, episode: str) -> bool:
        return (self.episodes is None or episode in self.episodes) and (self.paths is None or path in self.paths) and all(episode.startswith(b) for b in self.begins)


@dataclass
class OneFile(InputPartition):
    path: str
    episode: str


class TrajectoryReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.opener = options["path"], options.get("opener")
        self.schema = schema
        self.aliases = json.loads(options.get("aliases", "{}"))
        self.shortest = options.get("shortest", "true").lower() == "true"
        self.decoder = options.get("decoder")
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.takes(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        found = [OneFile(p, episode_of(p, self.root)) for p in trajectory_files(self.root)]
        return [f for f in found if self.wanted.has(f.path, f.episode)] or [OneFile("", "")]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with opened(partition.path, self.opener) as f:
                yield from self._batches(f, partition)

    def _source(self, f, column: str):
        """The data set behind a column by its aliases, and whether it is an encoded stream; null if there is none."""
        for group in ("frames", "videos"):
            if group in f:
                held = f[group]
                for name in [column, *self.aliases.get(column, [])]:
                    if name in held:
                        return held[name], group == "videos"
        return None, False

    def _batches(self, f, partition: OneFile) -> Iterator[pa.RecordBatch]:
        series = f["frames"] if "frames" in f else {}
        times = f["timestamps"] if "timestamps" in f else None
        count = int(f.attrs.get("frame_count", 0))
        lengths = [len(series[k]) for k in series.keys()] if len(series) else []
        if count <= 0:
            count = lengths[0] if lengths else len(times) if times is not None else 0
        fields = [c for c in self.schema.names if c not in {x.split()[0] for x in HEAD.split(", ")}]
        held = {c: self._source(f, c) for c in fields}
        decode = named(self.decoder) if self.decoder else None
        if decode is None and any(video for _, video in held.values()):
            raise ValueError("encoded streams need a decoder")
        frames = {c: list(decode(bytes(np.asarray(data[:], np.uint8)), dict(data.attrs))) for c, (data, video) in held.items() if video}
        n = min([count, *lengths, *map(len, frames.values()), *([len(times)] if times is not None else [])]) if self.shortest else count
        kinds = {k.name: k.dataType for k in self.schema}
        target = arrow_schema(self.schema)
        hi = n if self.wanted.hi is None else min(n, self.wanted.hi)
        for at in range(self.wanted.lo, hi, BATCH):
            end = min(at + BATCH, hi)
            columns = []
            for c in self.schema.names:
                if c in ("path", "episode_id"):
                    values = [partition.path if c == "path" else partition.episode] * (end - at)
                elif c == "frame_index":
                    values = list(range(at, end))
                elif c == "frame_count":
                    values = [count] * (end - at)
                elif c == "raw_ts":
                    values = padded([t.decode() if isinstance(t, bytes) else str(t) for t in times[at:end]] if times is not None else [], end - at)
                elif c in frames:
                    values = padded(frames[c][at:end], end - at)
                elif held[c][0] is None:
                    values = [None] * (end - at)
                else:
                    rows = np.asarray(held[c][0][at:end])
                    values = padded([r.reshape(-1).astype(float).tolist() for r in rows] if isinstance(kinds[c], ArrayType) else [r.tobytes() for r in rows] if isinstance(kinds[c], BinaryType) else rows.reshape(len(rows), -1)[:, 0].tolist(), end - at)
                columns.append(pa.array(values, target.field(c).type))
            yield pa.RecordBatch.from_arrays(columns, schema=target)


def padded(values: list, n: int) -> list:
    return values + [None] * (n - len(values))


def arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# Writing


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task has finished: place below the staging folder and below the root."""

    files: list[tuple[str, str]]


class TwoPhase:
    """Tasks write below a staging folder of their own job; commit moves what the successful tasks report, and nothing else
    is ever visible. What an append would replace stops the job before anything moves."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.job = f"_staging-{uuid.uuid4().hex}"

    def staged(self, name: str) -> str:
        """A place for a file; another attempt of the same task gets another."""
        store, root = store_of(self.root)
        place = f"{root}/{self.job}/{uuid.uuid4().hex}/{name}"
        store.create_dir(os.path.dirname(place))
        return place

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.root)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("an episode was written by more than one task: deal rows out by episode")
        there = {n for n in names if store.get_file_info(f"{root}/{n}").type == fs.FileType.File}
        if there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{len(there)} episodes are there already, {min(there)} among them")
        before = set(trajectory_files(self.root)) if self.overwrite else set()
        for place, name in files:
            store.create_dir(os.path.dirname(f"{root}/{name}"))
            store.move(place, f"{root}/{name}")
        for path in before - {f"{root}/{n}" for n in names}:
            store.delete_file(path)
        self.clean()

    def abort(self, messages) -> None:
        self.clean()

    def clean(self) -> None:
        from pyarrow import fs

        store, root = store_of(self.root)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class TrajectoryWriter(TwoPhase, DataSourceArrowWriter):
    """Rows of an episode must follow one another in order of frame_index; write_trajectories() sees to that. A task holds
    the episode it is at. An append must have the fields and widths of what is there."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.opener, self.fps, self.file = options.get("opener"), float(options.get("fps", 15)), FILES[options.get("container", "h5")]
        self.columns = [c for c in schema.names if c not in ("episode_id", "frame_index", "raw_ts")]
        self.widths: dict | None = None
        there = [] if overwrite else trajectory_files(self.root)
        if there:
            with opened(there[0], self.opener) as f:
                series = f["frames"]
                self.widths = {k: int(np.prod(series[k].shape[1:], dtype=int)) for k in series.keys()}
            if set(self.widths) != set(self.columns):
                raise ValueError(f"the files have {sorted(self.widths)}, the rows have {sorted(self.columns)}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        done, held, now = [], [], None
        for batch in batches:
            names = batch.column("episode_id").to_pylist()
            turns = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
            for lo, hi in zip([0, *turns], [*turns, len(names)]):
                if held and names[lo] != now:
                    done.append(self._episode(now, held))
                    held = []
                if hi > lo:
                    now = names[lo]
                    held.append(batch.slice(lo, hi - lo))
        if held:
            done.append(self._episode(now, held))
        return Staged(done)

    def _episode(self, episode, parts: list[pa.RecordBatch]) -> tuple[str, str]:
        rows = pa.Table.from_batches(parts)
        name = f"{episode}/{self.file}"
        place = self.staged(name)
        with open_file(place, self.opener)(place, "w") as f:
            f.attrs["frame_count"], f.attrs["video_fps"] = len(rows), self.fps
            if "raw_ts" in rows.column_names:
                f.create_dataset("timestamps", data=np.array([str(t).encode() for t in rows.column("raw_ts").to_pylist()]))
            series = f.create_group("frames")
            for c in self.columns:
                values = rows.column(c).combine_chunks()
                data = np.asarray(values.flatten() if pa.types.is_list(values.type) else values, float).reshape(len(rows), -1)
                if self.widths is not None and data.shape[1] != self.widths[c]:
                    raise ValueError(f"{c} of {episode} is {data.shape[1]} wide, {self.widths[c]} in the files")
                series.create_dataset(c, data=data)
        return place, name


class TrimmedWriter(TwoPhase, DataSourceWriter):
    """Rows path, name, start, end, n: each file cut to its frames [start, end), as ``name`` below the root."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.opener, self.video = options.get("opener"), options.get("video")

    def write(self, rows) -> Staged:
        from .sinks import copy_trimmed

        done = []
        for r in rows:
            place = self.staged(r["name"])
            with opened(r["path"], self.opener) as source, open_file(place, self.opener)(place, "w") as target:
                copy_trimmed(source, target, r["start"], r["end"], r["n"], named(self.video) if self.video else None)
                target.attrs["frame_count"] = r["end"] - r["start"]
            done.append((place, r["name"]))
        return Staged(done)


class Trajectories(DataSource):
    """Options: path; columns (comma-separated, where no schema is given); streams (columns that are encoded streams); aliases
    (a JSON object from column to names in files); shortest (cut all to the shortest series, true by default); opener;
    decoder (module:name of a function from bytes and attributes to frames); fps, container (h5 or npz)
    and trim (true: rows are ranges to cut) for writing."""

    @classmethod
    def name(cls) -> str:
        return "trajectories"

    def schema(self) -> str:
        columns = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        streams = {c.strip() for c in self.options.get("streams", "").split(",")}
        return ", ".join([HEAD, *(f"`{c}` {'binary' if c in streams else 'array<double>'}" for c in columns)])

    def reader(self, schema: StructType) -> TrajectoryReader:
        return TrajectoryReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if self.options.get("trim", "false").lower() == "true":
            return TrimmedWriter(dict(self.options), overwrite)
        return TrajectoryWriter(dict(self.options), schema, overwrite)


def write_trajectories(frames: DataFrame, root: str, mode: str = "append", **options: str) -> None:
    """Frames (episode_id, frame_index, raw_ts if there is one, and fields) as one file an episode, all of them or none."""
    register(frames.sparkSession)
    dealt = frames.repartition("episode_id").sortWithinPartitions("episode_id", "frame_index")
    dealt.write.format("trajectories").mode(mode).options(**options).save(root)


def write_trimmed(ranges: DataFrame, root: str, mode: str = "append", **options: str) -> None:
    """Trajectory files cut to their ranges (path, name, start, end, n), all of them or none. An overwrite leaves only
    these below the root."""
    register(ranges.sparkSession)
    ranges.select("path", "name", "start", "end", "n").repartition("name").write.format("trajectories").mode(mode).options(trim="true", **options).save(root)


# Replay


@dataclass
class Steps(InputPartition):
    path: str
    group: int
    start: int
    end: int


class FrameReplay(DataSourceStreamReader):
    """Rows of a Parquet folder by a column of steps. What is planned is never planned again, and after a restart the stream
    goes on from the checkpoint's last batch."""

    def __init__(self, options: dict, schema: StructType):
        self.root, self.schema = options["path"], schema
        self.steps, self.by = int(options.get("steps", 1)), options.get("by", "frame_index")
        self.end: int | None = None
        self.planned: int | None = None

    def _groups(self) -> Iterator[tuple[str, int, int, int]]:
        """Each row group with the least and the greatest step in it, by the files' footers."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, place = store_of(self.root)
        for info in sorted(store.get_file_info(fs.FileSelector(place, recursive=True)), key=lambda f: f.path):
            if info.is_file and info.path.endswith(".parquet"):
                footer = pq.read_metadata(info.path, filesystem=store)
                column = footer.schema.names.index(self.by)
                for g in range(footer.num_row_groups):
                    group = footer.row_group(g)
                    if group.num_rows:
                        seen = group.column(column).statistics
                        yield info.path, g, seen.min, seen.max

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        if self.end is None:
            self.groups = list(self._groups())
            self.end = max((hi + 1 for *_, hi in self.groups), default=0)
        return {"step": min((self.planned or 0) + self.steps, self.end)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi = start["step"], end["step"]
        self.planned = max(self.planned or 0, hi)
        if self.end is None:
            self.latestOffset()
        return [Steps(p, g, lo, hi) for p, g, least, most in self.groups if least < hi and most >= lo] if hi > lo else []

    def commit(self, end: dict) -> None:
        self.planned = max(self.planned or 0, end["step"])

    def read(self, partition: Steps) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, _ = store_of(self.root)
        target = arrow_schema(self.schema)
        with store.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(row_groups=[partition.group], columns=[*{*self.schema.names, self.by}]):
                at = batch.column(batch.schema.get_field_index(self.by))
                kept = batch.filter(pc.and_(pc.greater_equal(at, partition.start), pc.less(at, partition.end)))
                if kept.num_rows:
                    yield pa.RecordBatch.from_arrays([kept.column(kept.schema.get_field_index(k.name)).cast(k.type) for k in target], schema=target)


class FrameReplaySource(DataSource):
    """Options: path, a folder of Parquet files; by, a column of whole numbers from 0 (frame_index); steps, how many of them a
    trigger takes. The schema must be given. Planning reads footers alone, so of files sorted by the column each row group
    is read by the triggers that need it."""

    @classmethod
    def name(cls) -> str:
        return "frame_replay"

    def streamReader(self, schema: StructType) -> FrameReplay:
        return FrameReplay(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the two formats known to the session, and let filters reach Python sources: Spark refuses a source that takes
    filters where spark.sql.python.filterPushdown.enabled is off."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Trajectories)
    spark.dataSource.register(FrameReplaySource)


def replay_steps(spark: SparkSession, path: str, schema: StructType, steps: int = 1, by: str = "frame_index") -> DataFrame:
    """Recorded frames as a stream, the next steps of every episode a trigger."""
    register(spark)
    return spark.readStream.format("frame_replay").schema(schema).options(steps=steps, by=by).load(path)
