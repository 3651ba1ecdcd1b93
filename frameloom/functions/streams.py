"""Table functions that SQL can call: one record to many streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

# Endings of the fields that are camera streams.
STREAM_ENDINGS = ("_rgb", "_depth")


@arrow_udtf(returnType="episode_id bigint, frame_index bigint, stream string, camera_index int, payload array<double>")
class CameraStreams:
    """camera_streams(TABLE(frames) PARTITION BY episode_id): a row for each camera of a field, called key if there is one
    and key_i if there are several. frames: episode_id, frame_index, key (the field's name), cameras (an array of arrays).
    Fields that aren't streams, and records without cameras, give no rows. A batch is split at a time, none is held."""

    def eval(self, frames: pa.RecordBatch) -> Iterator[pa.Table]:
        keys = np.array(frames.column("key").to_pylist(), object)
        cameras = frames.column("cameras")
        wanted = np.array([k is not None and k.endswith(STREAM_ENDINGS) for k in keys], bool) & cameras.is_valid().to_numpy(zero_copy_only=False)
        kept = frames.filter(pa.array(wanted))
        cameras = kept.column("cameras")
        many = cameras.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(kept) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(many)), many)
        camera = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        names = [k if n == 1 else f"{k}_{i}" for k, n, i in zip(keys[wanted][row], many[row], camera)]
        at = pa.array(row)
        columns = [kept.column("episode_id").take(at), kept.column("frame_index").take(at), pa.array(names, pa.string()), pa.array(camera, pa.int32()), cameras.flatten().cast(pa.list_(pa.float64()))]
        yield pa.table(columns, names=["episode_id", "frame_index", "stream", "camera_index", "payload"])


def register(spark: SparkSession) -> None:
    spark.udtf.register("camera_streams", CameraStreams)
