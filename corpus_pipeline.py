"""From documents to packed training sequences: toxicity, exact and near duplicates, mixing, packing.

Each stage works on all rows its predecessor kept. All but the last return the columns of documents.

In every stage null texts count as empty, long texts are read whole, an empty table gives an empty result, rows that repeat a
doc_id are rows of their own unless said otherwise, and extra columns travel with their rows, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import exact_dedup, minhash, mixing, packing, toxicity
from frameloom.llm.common import written
from frameloom.session import share_package

#: Near duplicates: five words, a similarity of 0.8.
NEAR = minhash.Near(words=5, percent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier calls toxic; it learns from the labelled rows of docs. Null and empty texts
    score by the classifier's bias alone; without labels of both classes all score alike. Repeated rows score alike."""
    share_package(spark)
    return toxicity.keep_civil(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts (A-Z lower-cased) stays: the one with the largest doc_id, null being the smallest; of rows equal in
    both, one. Null and empty texts are equal."""
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id. Texts without words are linked
    with nothing and stay; rows with a null doc_id stay; of rows that repeat a doc_id all stay or none."""
    share_package(spark)
    return minhash.keep_first(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate and its own draw say. A null source is a source of its own, the
    last; rows of a source without words come once; rows that repeat a doc_id are drawn alike."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; an empty text is its end id alone."""
    share_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted classifier, hashed signatures and a tokenizer: not SQL. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
