"""Keyed state of many episodes under one key.

A call of transformWithStateInPandas costs some milliseconds for its key, whatever its rows: the state is asked for over a
socket, and a data frame is made. So the key is a bucket of episodes (by a hash of their id), and a bucket's state is one
Arrow table of a row an episode, read and written once a trigger. Buckets are as many as keep each small (buckets_for);
their number is fixed once a checkpoint is there. Null episodes have a bucket of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

#: Rows of a whole recording that one bucket holds, about.
ROWS = 50_000
LEAST_BUCKETS = 64


def fields(**kinds) -> StructType:
    return StructType([StructField(k, v()) for k, v in kinds.items()])


def buckets_for(rows: int) -> int:
    """How many buckets keep each at about ROWS rows."""
    return max(LEAST_BUCKETS, -(-rows // ROWS))


class Bucketed(StatefulProcessor):
    """kept: the columns of each named table of the state, beside the episode. out: the columns of the result."""

    kept: dict[str, StructType]
    out: StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = {k: handle.getValueState(k, fields(rows=BinaryType)) for k in self.kept}
        self.schemas = {k: to_arrow_schema(StructType([StructField("episode_id", LongType()), *v.fields])) for k, v in self.kept.items()}

    def load(self, name: str) -> dict[int, list[tuple]]:
        """Rows of the state by episode."""
        out: dict[int, list[tuple]] = {}
        if self.values[name].exists():
            table = pa.ipc.open_stream(pa.py_buffer(bytes(self.values[name].get()[0]))).read_all()
            for episode, *row in zip(*(c.to_pylist() for c in table.columns)):
                out.setdefault(episode, []).append(tuple(row))
        return out

    def store(self, name: str, rows: dict[int, list[tuple]]) -> None:
        every = [(episode, *row) for episode, found in rows.items() for row in found]
        if not every:
            self.values[name].clear()
            return
        schema, sink = self.schemas[name], pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*every), schema)], schema=schema))
        self.values[name].update((sink.getvalue().to_pybytes(),))

    def result(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """Rows of (episode, ...) as the columns of ``out``."""
        if rows:
            kinds = {"DoubleType": "float64", "LongType": "int64"}
            columns = dict(zip(self.out.names, zip(*rows)))
            found = pd.DataFrame({f.name: pd.Series(columns[f.name], dtype=kinds.get(type(f.dataType).__name__, "object")) for f in self.out})
            if key[0] < 0:
                found["episode_id"] = pd.Series([None] * len(found), dtype="Int64")
            yield found

    def close(self) -> None:
        pass


def episodes_of(rows: Iterator[pd.DataFrame], order: list[str], columns: list[str]) -> Iterator[tuple]:
    """For each episode of a bucket its id and a list for each column, sorted by ``order`` (nulls last)."""
    batch = pd.concat(list(rows), ignore_index=True).sort_values(["episode_id", *order], kind="stable", na_position="last")
    ids, lists = batch["episode_id"].to_numpy(), [batch[c].tolist() for c in columns]
    edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
    for lo, hi in zip(edges, edges[1:]):
        yield (int(ids[lo]), *(x[lo:hi] for x in lists))


def bucketed(stream: DataFrame, processor: Bucketed, buckets: int, time: str) -> DataFrame:
    """The rows of an operator over a stream with the columns episode_id and what the operator names."""
    bucket = F.when(F.col("episode_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("episode_id"), F.lit(buckets))).cast("int")
    rows = stream.withColumns({"_bucket": bucket, "episode_id": F.coalesce("episode_id", F.lit(0)).cast("bigint")})
    return rows.groupBy("_bucket").transformWithStateInPandas(processor, processor.out, "Append", time)
