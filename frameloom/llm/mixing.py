"""Mixing sources to target weights: tokens per source, repetition rates, floor copies plus one Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, written

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "mix-1"
#: A source table of at most so many rows is broadcast (under 10 MB with names of up to 1,000 bytes); a larger one is joined by shuffle.
BROADCAST_ROWS = 10_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"({WORD})")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """source, source_size, target. sizes: source, size.

    Sources ordered by code point, null last, weigh ``weights``, repeating. Their targets share the sum of all sizes
    by weight, none above ceiling times its source's size; what lies above is shared anew by weight. In closed form:
    target = min(ceiling * size, level * weight), where level solves sum(target) = sum(size). With the sources sorted
    by ceiling * size / weight, the first source that isn't held by its ceiling gives the level.
    """
    per = written(sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")), "sources")
    cycle = F.array(*[F.lit(w) for w in weights])
    # As many rows as there are sources: small beside the documents.
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    w = per.withColumn("w", F.element_at(cycle, ((order - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    w = w.withColumn("cap", F.col("source_size") * ceiling).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    w = w.withColumn("lv", (total - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")) / F.sum("w").over(rest).cast("double"))
    w = w.withColumn("level", F.min(F.when(F.col("lv") <= F.col("ratio"), F.struct("ratio", "lv"))).over(everything)["lv"])
    return w.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix_rates(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of each row, with _size, _source_size, _target and _copies.

    rate = target / source_size; copies = floor(rate) and one more where a hash of seed and doc_id, as a number in
    [0, 1), is below the fraction. Null text has size 0; null source is a source of its own; a source of size 0 has
    target 0 and its rows one copy (they hold no words, so it changes no total). Rows that repeat a doc_id are
    drawn alike. An empty table gives an empty result.
    """
    extra = [c for c in keep if c != "source"]
    sized = docs.select(*extra, docs["source"], words_in(docs["text"]).alias("_size"))
    if "_box" not in extra:
        sized = written(sized, "sizes")  # slim rows: words are counted once
    targets = written(source_targets(sized.select("source", F.col("_size").alias("size")), weights, ceiling), "targets")
    targets = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    if targets.count() <= BROADCAST_ROWS:
        targets = F.broadcast(targets)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(1.0))
    out = sized.join(targets, sized["source"].eqNullSafe(F.col("_source")))
    out = out.withColumn("_rate", rate).withColumn("_copies", (F.floor("_rate") + (draw < F.col("_rate") - F.floor("_rate")).cast("int")).cast("int"))
    return out.drop("_source", "_rate")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: each row of docs as often as it is drawn, with its columns (pipeline stage)."""
    rates = mix_rates(docs.select(boxed(docs), "doc_id", "source", "text"), keep=("_box", "doc_id"), **how)
    drawn = rates.select("_box", "_copies").where("_copies > 0")
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_box.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_rates(docs).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).cast("bigint").alias("taken"))


SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / w::DOUBLE AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lv FROM r),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT lv FROM l WHERE lv <= ratio ORDER BY ratio, lv LIMIT 1) * w) AS target FROM l),
k AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate,
        ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken FROM k
"""
