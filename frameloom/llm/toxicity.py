"""Toxicity: a linear classifier regularised by counterfactuals.

Each labelled text that names a group is paired with copies in which identity terms are swapped for others of the same
kind. The fit minimises the logistic loss plus ``penalty`` times the squared change of score within those pairs, so that
naming one group rather than another moves the score as little as possible.

Features are the distinct words of a text and their first four letters, hashed. Only features whose rate differs between
the classes by more than ``least_z`` standard errors take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts_of, written

TABLE = 1 << 20
STEM = 4
CACHE_WORDS = 50_000
_WORD = re.compile(r"[^\W\d_]+")

#: Identity terms by kind; within a kind each may stand for any other. Our own choice, a parameter of fit().
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrants", "refugees", "natives", "citizens"), ("disabled", "deaf", "blind"), ("elderly", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)


@dataclass(frozen=True)
class Fit:
    """per_class bounds the sample: at most so many labelled rows of each class, by a hash of doc_id,
    weighted back to the class's true number."""

    per_class: int = 6000
    penalty: float = 10.0
    least_z: float = 4.0
    ridge: float = 1e-3
    steps: int = 400
    identity: tuple[tuple[str, ...], ...] = field(default=IDENTITY, repr=False)


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float

    def score(self, hits) -> float:
        return 1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights.get(h, 0.0) for h in hits), -40, 40)))


def word_features(word: str) -> tuple[int, ...]:
    return tuple(dict.fromkeys((xxhash.xxh32_intdigest("=" + word) % TABLE, xxhash.xxh32_intdigest("^" + word[:STEM]) % TABLE)))


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(words: set[str]) -> set[int]:
    return {f for w in words for f in word_features(w)}


def swaps(words: set[str], identity: tuple[tuple[str, ...], ...]) -> list[set[str]]:
    """The text's words with each identity term replaced by the next of its kind, then by the one after, and so on."""
    kinds = [k for k in identity if any(t in words for t in k)]
    out = []
    for step in range(1, max((len(k) for k in kinds), default=1)):
        turn = {t: k[(i + step) % len(k)] for k in kinds for i, t in enumerate(k)}
        out.append({turn.get(w, w) for w in words})
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, how: Fit) -> pa.Table:
    """toxic, features of the text, features that each of its counterfactuals adds and takes away, and weight, for a
    bounded hash sample of the labelled documents. The weight is the number of labelled documents of the class over those
    sampled, so that the sample stands for the true ratio of the classes.

    labels: doc_id, toxic. A doc_id with several labels counts as toxic if one says so; null labels are left out, and so
    are labels without a document. A doc_id that documents repeat counts once, with one of its texts (by its hash): no
    more than per_class texts of each class come to the driver."""
    truth = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    there = written(texts.select("doc_id", "h").join(truth, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("h").alias("h")), "labelled")
    pick = lambda c: there.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(how.per_class)
    totals = {r["toxic"]: r["n"] for r in there.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).where("toxic in (0, 1)").collect()}
    weight = {c: max(1.0, n / how.per_class) for c, n in totals.items()}
    sample = F.broadcast(pick(0).unionByName(pick(1)))  # at most 2 * per_class rows
    rows = texts.join(sample, ["doc_id", "h"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")).select("toxic", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own, plus, minus = [], [], []
            for text in texts_of(batch.column("text")):
                words = words_of(text)
                a = features(words)
                others = [features(w) for w in swaps(words, how.identity)]
                own.append(sorted(a))
                plus.append([sorted(b - a) for b in others])
                minus.append([sorted(a - b) for b in others])
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, lists), pa.array(plus, pa.list_(lists)), pa.array(minus, pa.list_(lists))], ["toxic", "own", "plus", "minus"])

    found = rows.mapInArrow(extract, "toxic int, own array<int>, plus array<array<int>>, minus array<array<int>>").toArrow()
    return found.append_column("weight", pa.array([weight[c] for c in found["toxic"].to_pylist()], pa.float64()))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and the row of each value."""
    a = column.combine_chunks()
    lengths = np.diff(a.offsets.to_numpy())
    return a.flatten().to_numpy(), np.repeat(np.arange(len(a), dtype=np.int32), lengths)


def _flat_pairs(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same for lists of lists: values, the inner list of each value, and the number of inner lists."""
    value, pair = _flat(pa.chunked_array([column.combine_chunks().flatten()]))
    return value, pair, int(np.sum(np.diff(column.combine_chunks().offsets.to_numpy())))


def fit(sample: pa.Table, how: Fit = Fit()) -> Model:
    """The classifier, fitted to the weighted rows. Without rows of both classes it scores everything by the share of
    toxic rows."""
    y = sample["toxic"].to_numpy().astype(float)
    n, n1 = len(y), y.sum()
    weight = sample["weight"].to_numpy()
    whole, toxic = weight.sum(), (weight * y).sum()
    if not n or n1 in (0, n):
        share = (toxic + 0.5) / (whole + 1) if n else 0.01
        return Model({}, float(np.log(share / (1 - share))))
    value, row = _flat(sample["own"])
    every = np.bincount(value, minlength=TABLE)
    hit1 = np.bincount(value[(y == 1)[row]], minlength=TABLE)
    hit0 = every - hit1
    p1, p0, p = hit1 / n1, hit0 / (n - n1), (hit1 + hit0) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1)))
    used = np.flatnonzero(np.nan_to_num(np.abs(z)) > how.least_z)
    place = np.full(TABLE, -1, np.int32)
    place[used] = np.arange(len(used))
    at = place[value] >= 0
    f, r = place[value[at]], row[at]
    # Counterfactual pairs: the features that a swap adds or takes away.
    changes = []
    for name, sign in (("plus", 1.0), ("minus", -1.0)):
        feature, pair, pairs = _flat_pairs(sample[name])
        used_here = place[feature] >= 0
        changes.append((place[feature[used_here]], pair[used_here], np.full(used_here.sum(), sign)))
    df, dr, ds = (np.concatenate(c) for c in zip(*changes))
    w, bias = np.zeros(len(used)), np.log(toxic / (whole - toxic))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, how.steps + 1):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(r, weights=w[f], minlength=n) + bias, -40, 40)))
        miss = weight * (s - y)
        g = np.bincount(f, weights=miss[r], minlength=len(w)) / whole + how.ridge * w
        if pairs:
            change = np.bincount(dr, weights=w[df] * ds, minlength=pairs)
            g += 2 * how.penalty / pairs * np.bincount(df, weights=change[dr] * ds, minlength=len(w))
        gb = miss.sum() / whole
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 / (1 + step / 100)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return Model({int(k): float(x) for k, x in zip(used, w)}, float(bias))


def train(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> Model:
    """A model from rows that may be learned from: those whose crc32(doc_id as text) mod 5 is not 0."""
    return fit(labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), how), how)


def scorer(model: Model):
    """A vectorised function from text to score in [0, 1]. Null and empty texts get the bias alone."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, ...]] = {}

        def hits(word: str) -> tuple[int, ...]:
            if (found := known.get(word)) is None:
                if len(known) > CACHE_WORDS:
                    known.clear()
                found = known[word] = tuple(x for x in word_features(word) if x in model.weights)
            return found

        for texts in batches:
            yield pa.array([model.score({h for w in words_of(t) for h in hits(w)}) for t in texts_of(texts)], pa.float64())

    return score


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5, is 0; a null doc_id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for each row of docs; other columns are ignored, repeated rows score alike.

    Null and empty texts get the bias alone; long texts are read whole, and length doesn't matter, since each distinct
    word counts once; an empty table gives an empty result."""
    scored = docs.select("doc_id", scorer(model)(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below 0.5, with all their columns (pipeline stage)."""
    return docs.where(scorer(model)(F.col("text").cast("string")) < 0.5)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
