"""Near-duplicates: universal hash minima, banding, signature verification, exact confirmation, connected components.

1. Each text becomes its set of word shingles (64-bit hashes), ``bands * rows`` minima under universal hash functions,
   and one key for each band. Texts with equal sets form a class; its smallest doc_id stands for it from here on.
2. In each bucket of a band, members link to the bucket's smallest member. Components of these links are the coarse
   clusters; any two sets that share a band key are in one cluster. No bucket is expanded into pairs.
3. Inside a cluster, sets of different components are compared: first their signatures, then the full sets. Members
   nearest to the cluster's commonest minima go first, so a group of near copies joins up after a few comparisons.
   Clusters beyond a bound are cut into blocks, then the blocks' hubs are compared, in blocks again; what that doesn't
   join to the cluster's main part is compared with the members that share a band with it.
4. Components of the confirmed links give the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, maybe_in, slices, texts_of, without, written
from .components import connected_components

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Near:
    """Linked: 100 * |A and B| >= percent * |A or B| for sets of ``words``-word shingles.

    At similarity s a link misses every band with chance (1 - s**rows)**bands: 7e-6 at 0.8, 2e-8 at 0.85.
    block_docs and block_shingles bound what one task compares.
    """

    words: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 5
    block_docs: int = 4000
    block_shingles: int = 4_000_000

    @property
    def least_agreement(self) -> float:
        t = self.percent / 100
        return t - 5 * math.sqrt(t * (1 - t) / (self.bands * self.rows))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, a text without words has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, n)
    k = min(words, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _M1 + h[i : n - k + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a non-empty set, a few thousand members at a time."""
    least = None
    for at in range(0, len(s), 2048):
        part = (s[at : at + 2048][None, :] * a[:, None] + b[:, None]).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least


def _band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for column in sig.reshape(bands, -1).T:
        keys = _mixed(keys * _M1 + column)
    return keys.view(np.int64)


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null when empty) and bands, for each row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(near.bands * near.rows)
        for batch in slices(batches, 2000):
            sizes, digests, keys = [], [], []
            for text in texts_of(batch.column("text")):
                s = shingle_set(text, near.words)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(_band_keys(signature(s, a, b), near.bands) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(sketch, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def _joined_up(ids: np.ndarray, labels: np.ndarray, query: np.ndarray, sets: list[np.ndarray], near: Near) -> tuple[np.ndarray, int]:
    """Component of each row (as the index of one of its rows) after comparing the queries with all rows that are in
    another component; and the row nearest to the commonest minima of the largest component."""
    n = len(ids)
    _, comp = np.unique(labels, return_inverse=True)
    a, b = _coefficients(near.bands * near.rows)
    sig = np.stack([signature(s, a, b) for s in sets])
    usual = np.zeros(n)
    for column in sig.T if n > 8 else ():
        _, at, count = np.unique(column, return_inverse=True, return_counts=True)
        usual += count[at]
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((ids, -usual))
    done = np.zeros(n, bool)
    for i in order[query[order]]:
        done[i] = True
        fits = np.flatnonzero((comp != comp[i]) & ~done & (100 * np.minimum(sizes, sizes[i]) >= near.percent * np.maximum(sizes, sizes[i])))
        if not len(fits):
            if (comp == comp[i]).all():
                break
            continue
        fits = fits[(sig[fits] == sig[i]).mean(axis=1) >= near.least_agreement]
        for j in fits:
            if comp[j] != comp[i]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= near.percent * (sizes[i] + sizes[j] - both):
                    comp[comp == comp[j]] = comp[i]
    largest = np.bincount(comp).argmax()
    inside = order[comp[order] == largest]
    return comp, int(inside[0])


def _compared(rows: DataFrame, near: Near) -> DataFrame:
    """rows: key (the task's group), id, label, query, text. Returns links: id, root (smallest id it joins up with
    there), hub (the row nearest to the middle of the group's largest component)."""

    def one(group: list[pd.DataFrame]) -> pd.DataFrame:
        g = pd.concat(group, ignore_index=True) if len(group) > 1 else group[0].reset_index(drop=True)
        ids = g["id"].to_numpy()
        comp, hub = _joined_up(ids, g["label"].to_numpy(), g["query"].to_numpy(bool), [shingle_set(t, near.words) for t in g["text"]], near)
        root = pd.Series(ids).groupby(comp).transform("min")
        return pd.DataFrame({"key": g["key"], "id": ids, "root": root, "hub": np.arange(len(g)) == hub})

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for _, part in batch.groupby("key", sort=False):
                if held and held[0]["key"].iat[0] != part["key"].iat[0]:
                    yield one(held)
                    held = []
                held.append(part)
        if held:
            yield one(held)

    return rows.select("key", "id", "label", "query", "text").repartition("key").sortWithinPartitions("key").mapInPandas(groups, "key string, id bigint, root bigint, hub boolean")


def _blocked(rows: DataFrame, sizes: DataFrame, near: Near) -> DataFrame:
    """rows with ``blocks`` and ``block``: as many blocks of a component as keep one within what a task compares.
    rows: id, component; sizes: component, n_shingles."""
    per = sizes.groupBy("component").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s"))
    blocks = F.greatest(F.ceil(F.col("_n") / near.block_docs), F.ceil(F.col("_s") / near.block_shingles))
    blocks = F.least(blocks, F.ceil(F.col("_n") / 2)).cast("bigint")  # blocks of two at least, so that hubs grow fewer
    out = rows.join(per.select("component", blocks.alias("blocks")), "component")
    return out.withColumn("block", F.pmod(F.xxhash64("id", F.col("blocks")), F.col("blocks")))


def _within(texts: DataFrame, near: Near) -> DataFrame:
    """What the members of each block join up with in it. texts: component, block, id, n_shingles, text."""
    key = F.concat_ws("/", F.col("component"), F.col("block"))
    return written(_compared(texts.select(key.alias("key"), "id", F.col("id").alias("label"), F.lit(True).alias("query"), "text"), near), "links")


def _confirmed(docs: DataFrame, coarse: DataFrame, classes: DataFrame, near: Near) -> DataFrame:
    """Links (id, root) that hold on full sets. coarse: id, component, n_shingles; classes: rep, bands."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    members = _blocked(coarse.select("id", "component", "n_shingles"), coarse, near)
    texts = maybe_in(slim, ["id"], coarse.select("id")).where("text is not null").join(members, "id")
    first = _within(texts, near)
    links = first.select("id", "root")
    large = members.where("blocks > 1").select("component").distinct()
    if not large.limit(1).count():
        return links
    # Beyond the bound: the hubs of a component's blocks are compared in blocks of their own, and so on, until one block
    # holds a component's hubs. Each text is sent once a level, and each level has few of the one before.
    texts = written(texts.join(large, "component", "left_semi"), "large")
    hubs = texts.join(first.where("hub").select("id").distinct(), "id", "left_semi")
    while True:
        hubs = written(_blocked(hubs.drop("blocks", "block"), hubs, near), "hubs")
        found = _within(hubs, near)
        links = links.unionByName(found.select("id", "root"))
        if not hubs.where("blocks > 1").limit(1).count():
            break
        hubs = hubs.join(found.where("hub").select("id").distinct(), "id", "left_semi")
    # What is still apart from its component's main part is compared with all members that share a band with it.
    comps = written(connected_components(links, "id", "root"), "comps")
    known = texts.join(comps, "id", "left").withColumn("label", F.coalesce(comps["component"], F.col("id"))).select(texts["component"], "block", "id", "label", "text")
    known = written(known, "large")
    main = known.groupBy("component", "label").count().groupBy("component").agg(F.max(F.struct("count", "label"))["label"].alias("main"))
    apart = known.join(main, "component").where("label <> main").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)))
    sized = apart.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / near.block_docs).cast("bigint").alias("chunks"))
    apart = written(apart.join(sized, "component").withColumn("chunk", F.col("chunk") % F.col("chunks")), "apart")
    if apart.limit(1).count():
        bands = classes.select(F.col("rep").alias("id"), F.explode("bands").alias("band"))
        asked = apart.join(bands, "id").select("component", "chunk", "band").distinct()
        shares = known.select("component", "block", "id").join(bands, "id").join(asked, ["component", "band"]).select("component", "block", "chunk", "id").distinct()
        shares = written(shares, "shares")
        spots = shares.select("component", "block", "chunk").distinct()
        asked = spots.join(apart.select("component", "chunk", "id", "label", "text"), ["component", "chunk"]).withColumn("query", F.lit(True))
        other = shares.join(known.select("id", "label", "text"), "id").withColumn("query", F.lit(False))
        rows = asked.unionByName(other.select(asked.columns)).withColumn("key", F.concat_ws("/", "component", "block", "chunk"))
        links = links.unionByName(written(_compared(rows, near), "links").select("id", "root"))
    return links


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable through links) and kept, for each row of docs.

    Words are runs without ASCII white space, after lower-casing A-Z. Fewer words than a shingle make one shingle; null,
    empty or blank texts have none and link with nothing. A row with null doc_id links with nothing, has a null
    component and is kept. Rows that repeat a doc_id are one node: all are kept or none is. Empty tables give empty
    results. Other columns are ignored.
    """
    drawn = written(sketches(docs, near), "sketches")
    nodes = drawn.where("doc_id is not null and digest is not null")
    classes = written(nodes.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n_shingles")), "classes")
    keyed = classes.select("rep", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hub")
    stars = keyed.join(buckets, "band").where("rep <> hub").select("rep", "hub").distinct()
    coarse = written(connected_components(stars, "rep", "hub").join(classes.groupBy(F.col("rep").alias("id")).agg(F.max("n_shingles").alias("n_shingles")), "id"), "coarse")
    links = _confirmed(docs, coarse, classes, near)
    same = nodes.join(classes.select("digest", "rep"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("id"), F.col("rep").alias("root"))
    comps = written(connected_components(links.unionByName(same), "id", "root"), "comps")
    out = drawn.select("doc_id", "n_shingles").join(comps, drawn["doc_id"] == comps["id"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest doc_id, with all its columns (pipeline stage)."""
    dropped = near_duplicates(docs, near).where("not kept").select(F.col("doc_id").alias("_key")).distinct()
    rows = docs.select(boxed(docs), F.col("doc_id").cast("bigint").alias("_key"))
    return without(rows, ["_key"], written(dropped, "dropped")).select("_box.*")


#: The query's contract: three words, 0.85.
OP10 = Near(words=3, percent=85)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), OP10)
