"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked; the fraction (rank - 1/2) / rows of the source orders
all rows; the order is cut into equal runs. Each run then holds each source in the proportion of the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOCATOR, boxed, located, rooted, text_of, written

SHARDS = 16
SEED = "shard-1"
#: Rows that one ranking task is meant to sort.
TASK_ROWS = 200_000


def _global_rank(rows: DataFrame, groups: list[str], bucket: str, order: list, name: str, counts: str) -> DataFrame:
    """rows with ``name``, the 0-based rank in ``order`` within groups, and ``counts``, the rows of the group.
    bucket must grow along order, so ranks are counted in each bucket and shifted by what the buckets before it hold."""
    per = rows.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(counts, F.sum("_n").over(w)).drop("_n")
    keys = [*groups, bucket]
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(per, keys).withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_r", "_before")


def stratified_shards(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, task_rows: int = TASK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the locator _file, _row, for each row of docs.

    size is the text's UTF-8 bytes plus 1; null text counts as empty, null source as a source of its own. Shards hold
    equally many rows, or one more (law ``rows``); slots are gapless from 0 within a shard. Rows that repeat a doc_id
    are told apart by their place in the table. Fewer rows than shards leave shards empty; an empty table gives an empty
    result. Very long texts count by their bytes. Documents with equal texts are rows like others and may lie in different
    shards. Extra columns are ignored.
    """
    rows = located(docs, "doc_id", "source", "text")
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    slim = rows.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("_source"),
        (F.octet_length(text_of(rows)) + 1).cast("bigint").alias("size"),
        F.crc32(text_of(rows)).alias("text_crc32"),
        F.xxhash64(key).alias("_u"),
        *LOCATOR,
    )
    slim = written(slim, "shard-rows")
    n = slim.count()
    bits = max(0, (max(n, 1) // task_rows).bit_length())
    by_hash = slim.withColumn("_b", F.shiftright(F.col("_u"), 64 - bits) if bits else F.lit(0).cast("bigint"))
    ranked = _global_rank(by_hash, ["_source"], "_b", ["_u", "doc_id", *LOCATOR], "_rank", "_rows").drop("_b")
    fraction = (F.col("_rank") + F.lit(0.5)) / F.col("_rows")
    parts = 1 << (bits + 4)
    spread = ranked.withColumn("_f", fraction).withColumn("_g", F.floor(F.col("_f") * parts))
    placed = _global_rank(spread.drop("_rows"), [], "_g", ["_f", "_source", "_u", *LOCATOR], "_pos", "_all")
    shard = F.expr(f"(_pos * {shards}) div _all").cast("int")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_pos") - first).cast("bigint").alias("slot"), *LOCATOR)


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """The shards as Parquet folders shard=0, shard=1 ..., rows in slot order within each file. Columns named shard or
    slot are replaced."""
    docs = rooted(docs)
    kept = docs.drop("shard", "slot")
    where = stratified_shards(docs, **how).select(*LOCATOR, "shard", "slot")
    rows = located(docs, boxed(kept)).join(where, LOCATOR).select("_box.*", "shard", "slot")
    rows.repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = stratified_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
