"""Language identification by mixture inference.

Byte n-grams of letters, hashed into a fixed table, give each language a likelihood. A document is taken as a mixture:
its words are the observations, and expectation-maximisation estimates the share of each language. Languages enter the
document's set one by one, largest share first, as long as the likelihood gains more than a penalty that grows with the
logarithm of the number of words. The prediction is the language with the largest share within that set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts_of

#: Hashed n-grams: the model has TABLE rows for each language, whatever the corpus.
TABLE = 1 << 15
GRAM = 4
SMOOTH = 0.5
#: Log-likelihood that each further language must gain for each unit of log(words + 1).
PENALTY = 3.0
ROUNDS = 12
#: More values of lang are refused; up to so many, counts take 256 KB of a task's memory each, and the driver gets 8 million
#: counts of 24 bytes at most.
LANGUAGES = 256
#: Likelihoods (words times languages) that are held at once; those of a longer text are worked out again in every round.
HELD = 2_000_000
#: Letters keep their byte, all else is the space 0.
_BYTE = np.array([b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams at each position and the positions where words start; the space before a word belongs to it."""
    b = _BYTE[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)]
    b = b[(b != 0) | np.concatenate([[True], b[:-1] != 0])]
    n = len(b) - 1 if b[-1] == 0 else len(b)
    if n <= 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    b = np.concatenate([b[:n], np.zeros(GRAM, np.uint32)])
    h = np.zeros(n, np.uint32)
    for i in range(GRAM):
        h = (h ^ b[i : n + i]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B) >> np.uint32(17)).astype(np.int64) % TABLE, np.flatnonzero(b[:n] == 0)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the table of log-likelihoods [TABLE, languages], from all rows with text and lang.
    What comes to the driver is at most TABLE counts for each language; with more than LANGUAGES of them, which only a
    lang column of something else has, it refuses."""
    used = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    n = used.select("lang").distinct().limit(LANGUAGES + 1).count()
    if n > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values; that is no column of languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(texts_of(batch.column("text")), texts_of(batch.column("lang"))):
                if lang not in held:
                    held[lang] = np.zeros(TABLE, np.int64)
                held[lang] += np.bincount(grams(text)[0], minlength=TABLE)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "gram", "n"])

    rows = used.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    coded = rows["lang"].combine_chunks().dictionary_encode()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
    langs = sorted(coded.dictionary.to_pylist())
    place = np.array([langs.index(x) for x in coded.dictionary.to_pylist()], np.int64)
    counts = np.zeros((TABLE, len(langs)))
    counts[rows["gram"].to_numpy(), place[coded.indices.to_numpy()]] = rows["n"].to_numpy()
    return langs, np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * TABLE)).astype(np.float32)


def shares(words: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation: share of each language and the log-likelihood. words: log-likelihood [word, language]."""
    top = words.max(axis=1, keepdims=True)
    p = np.exp(words - top)
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(ROUNDS):
        r = p * share
        share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    return share, float(np.log((p * share).sum(axis=1)).sum() + top.sum())


class Words:
    """Log-likelihoods of a text's words [word, language], in parts of HELD values at most. Words that are alike are one
    word with a count, and its likelihoods are worked out anew whenever the parts are gone through."""

    def __init__(self, gram: np.ndarray, starts: np.ndarray):
        ends = np.concatenate([starts[1:], [len(gram)]])
        mixed = (gram.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= (np.arange(len(gram), dtype=np.uint64) - np.repeat(starts, ends - starts).astype(np.uint64)) * np.uint64(2) + np.uint64(1)
        _, first, self.count = np.unique(np.add.reduceat(mixed, starts), return_index=True, return_counts=True)
        self.gram, self.lo, self.hi = gram, starts[first], ends[first]
        self.n = int(self.count.sum())

    def parts(self, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Log-likelihoods by some columns of the table, and how often each word occurs."""
        most = max(1, HELD // table.shape[1])
        size = self.hi - self.lo
        part = (np.cumsum(size) - size) // most
        for k in np.unique(part):
            here = part == k
            lo, size_ = self.lo[here], size[here]
            at = np.arange(size_.sum()) - np.repeat(np.cumsum(size_) - size_, size_) + np.repeat(lo, size_)
            cuts = np.cumsum(size_) - size_
            # A word longer than a part is summed in pieces.
            words = np.zeros((len(lo), table.shape[1]))
            for piece in range(0, len(at), most):
                owner = np.searchsorted(cuts, np.arange(piece, min(piece + most, len(at))), "right") - 1
                turn = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                words[owner[turn]] += np.add.reduceat(table[self.gram[at[piece : piece + most]]], turn, axis=0)
            yield words, self.count[here]


def shares_of(words: Words, table: np.ndarray) -> tuple[np.ndarray, float]:
    """shares() of words in parts, among the table's languages."""
    n = table.shape[1]
    share = np.full(n, 1 / n)
    for turn in range(ROUNDS + 1):
        total, likelihood = np.zeros(n), 0.0
        for w, count in words.parts(table):
            top = w.max(axis=1, keepdims=True)
            r = np.exp(w - top) * share
            whole = r.sum(axis=1, keepdims=True)
            total += (count[:, None] * r / whole).sum(axis=0)
            likelihood += float((count * (np.log(whole) + top)[:, 0]).sum())
        if turn < ROUNDS:
            share = total / words.n
    return share, likelihood


def infer(text: str | None, table: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Share of each language in the chosen set (0 outside it) and confidence; None for a text without letters."""
    if not text or not table.shape[1] or not any(map(str.isalpha, text)):
        return None
    gram, starts = grams(text)
    if not len(starts):
        return None
    n, size = table.shape[1], len(starts)
    if len(gram) * n <= HELD:
        words = np.add.reduceat(table[gram], starts, axis=0).astype(np.float64)
        mixture = lambda chosen: shares(words[:, chosen])
        single = words.sum(axis=0)
    else:
        held = Words(gram, starts)
        mixture = lambda chosen: shares_of(held, table[:, chosen])
        single = sum((count[:, None] * w).sum(axis=0) for w, count in held.parts(table))
    share, _ = mixture(list(range(n)))
    order = np.argsort(-share, kind="stable")
    chosen = [int(order[0])]
    out, best = np.ones(1), single[chosen[0]]
    for x in order[1:]:
        if share[x] < 0.02:
            break
        part, gained = mixture([*chosen, int(x)])
        if gained - best <= PENALTY * np.log(size + 1):
            break
        chosen, out, best = [*chosen, int(x)], part, gained
    full = np.zeros(n)
    full[chosen] = out
    sure = 1 / np.exp(np.clip(single - single[full.argmax()], -700, 50)).sum()
    return full, float(sure if len(chosen) == 1 else 1.0)


def identify(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score, langs (map of language to share) for each row of docs; other columns are ignored.

    Null, empty and letterless texts (no character that str.isalpha() calls a letter), and all texts when nothing was
    learned, give ``und``, score 0 and an empty map. Long texts are read whole; an empty table gives an empty result.
    The score is the predicted language's share, for a single language times its likelihood among all languages.
    """
    told = docs.sparkSession.sparkContext.broadcast((langs, table))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = told.value
        for batch in slices(batches):
            pred, score, mixed = [], [], []
            for text in texts_of(batch.column("text")):
                found = infer(text, model)
                if found is None:
                    pred.append("und"), score.append(0.0), mixed.append([])
                    continue
                share, sure = found
                best = int(share.argmax())
                pred.append(names[best])
                score.append(float(min(1.0, max(0.0, share[best] * sure))))
                mixed.append([(names[i], float(share[i])) for i in np.flatnonzero(share)])
            kind = pa.map_(pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, kind)], ["doc_id", "lang_pred", "score", "langs"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(predict, "doc_id bigint, lang_pred string, score double, langs map<string,double>")


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3, is 1; a null doc_id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, table = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, langs, table).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs")
