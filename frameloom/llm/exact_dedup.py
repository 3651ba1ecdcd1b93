"""Exact deduplication as a stream with keyed state on disk.

Each row becomes a log entry: SHA-256 of the normalised text, the stable identifier (doc_id) and a content locator
(file and row). A stateful stream reads the log; its state (RocksDB, no expiry) holds for each digest the entry that
stays and the number of rows seen. Where a digest is hit more than once, the full texts are grouped byte by byte;
a digest that stands for two texts is split by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOCATOR, ascii_lower, boxed, located, maybe_in, rooted, shared_dir, text_of, without, written

#: State lives in RocksDB on disk; a store is closed when its part of a batch is committed, so many parts don't add up.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def digest_log(docs: DataFrame) -> DataFrame:
    """doc_id, digest, _file, _row for each row, in the shared folder."""
    rows = located(docs, "doc_id", "text")
    return written(rows.select("doc_id", F.unhex(F.sha2(ascii_lower(text_of(rows)), 256)).alias("digest"), *LOCATOR), "digests")


def stream_state(log: DataFrame, files_per_batch: int = 1000, checkpoint: str | None = None) -> DataFrame:
    """digest, keep (struct of doc_id, _file, _row) and group_size, from a stream over the log's files.
    With a checkpoint folder of an earlier call, the state carries on from there."""
    spark = log.sparkSession
    work = shared_dir(spark, "dedup")
    folder = log.inputFiles()[0].rsplit("/", 1)[0] if log.inputFiles() else None
    schema = "digest binary, keep struct<doc_id: bigint, _file: string, _row: bigint>, group_size bigint"
    if folder is None:
        return spark.createDataFrame([], schema)
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        state = source.groupBy("digest").agg(F.max(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), *LOCATOR)).alias("keep"), F.count(F.lit(1)).alias("group_size"))

        def keep_changes(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{work}/changes/batch={number}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint or f"{work}/state").trigger(availableNow=True).foreachBatch(keep_changes).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{work}/changes")
    return changes.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))


def collided(docs: DataFrame, log: DataFrame, state: DataFrame) -> DataFrame:
    """Full-byte check of all hits: digests that stand for more than one text, with those texts' rows."""
    hits = state.where("group_size > 1").select("digest")
    hit_rows = written(log.join(hits, "digest", "left_semi").select(*LOCATOR), "hits")
    rows = located(docs, "doc_id", "text")
    rows = maybe_in(rows, LOCATOR, hit_rows).withColumn("_norm", ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    texts = rows.groupBy("_norm").agg(F.count(F.lit(1)).alias("n")).withColumn("digest", F.unhex(F.sha2("_norm", 256)))
    return texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")


def _stays() -> Column:
    return (F.col("_file") == F.col("keep._file")) & (F.col("_row") == F.col("keep._row"))


def exact_dedup(docs: DataFrame, files_per_batch: int = 1000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the row's locator _file, _row.

    Texts are equal when identical after lower-casing A-Z. The largest doc_id of a group stays; of repeated rows
    with that doc_id exactly one, the last by locator. Null text counts as empty; a null doc_id sorts below all others
    and is kept where the whole group has none. An empty table gives an empty result. Columns other than doc_id and
    text are ignored, so their names can't clash.
    """
    docs = rooted(docs)
    log = digest_log(docs)
    state = written(stream_state(log, files_per_batch), "dedup-state")
    two = collided(docs, log, state).limit(1).count()
    if two:
        return _split_by_text(docs)
    return (
        log.join(state, "digest")
        .select(
            "doc_id",
            F.col("keep.doc_id").alias("keep_id"),
            "group_size",
            _stays().alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            *LOCATOR,
        )
    )


def _split_by_text(docs: DataFrame) -> DataFrame:
    """The same result keyed by whole texts: taken only where two texts share a SHA-256 digest."""
    rows = located(docs, "doc_id", "text").withColumn("_norm", ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))).drop("text")
    keep = rows.groupBy("_norm").agg(F.max(F.struct("doc_id", *LOCATOR)).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(keep, "_norm").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", _stays().alias("kept"), F.sha2("_norm", 256).alias("text_sha256"), *LOCATOR)


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns (pipeline stage)."""
    docs = rooted(docs)
    dropped = written(exact_dedup(docs).where("not kept").select(*LOCATOR), "dropped")
    return without(located(docs, boxed(docs)), LOCATOR, dropped).select("_box.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop(*LOCATOR)


#: Equal texts by value; of repeated doc_ids any row stays, so the oracle holds for tables whose doc_ids are unique.
SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
